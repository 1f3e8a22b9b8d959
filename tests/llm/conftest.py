import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text, lowered=False):
    return WORD.findall(lower(text or "") if lowered else text or "")


def corpus():
    """Texts with copies, near copies, shared passages, secrets, odd spaces, other scripts, and the empty cases."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice(["th", "an", "er", "ion", "öß", "él", "st"]) for _ in range(r.randint(1, 3))) for _ in range(90)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = line(70)
    out = [None, "", "   \n\t ", "one", "two words", "Four words in ONE", "x" * 3000, "\x1ca b\u00a0c \u2028 d", "▁mark▁ <s> 日本語 🙂 \r\n\r\n end"]
    for i in range(50):
        text = "\n".join(line(r.randint(4, 14)).capitalize() + "." for _ in range(r.randint(1, 12)))
        out.append(text)
        if i % 4 == 0:
            out.append(text)
        if i % 3 == 0:
            w = text.split(" ")
            w[r.randrange(len(w))] = "edited"
            out.append(" ".join(w))
        if i % 5 == 0:
            out.append(line(20) + " " + passage + " " + line(20))
        if i % 6 == 0:
            out.append(text + f"\npassword = 'abc{i}DEF.gh' AKIA{'Z9' * 10} {'0a' * 20} tok secret:short token=longenough{i}")
    out.append(" ".join([line(5)] * 40))
    out.append(line(6000))
    return list(enumerate(out))


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The corpus with its repeated rows, and columns whose names operators use themselves."""
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 4}", len(t or ""), i, "k", i) for i, t in texts]
    rows += rows[12:15]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, key string, size long").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
