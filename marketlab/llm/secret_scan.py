"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over lower-cased byte trigrams is derived: what
a match must contain, as a tree of ALL and ANY. Every block of documents builds posting lists of the
trigrams that some rule needs, the queries intersect and unite those lists, and only candidates are
verified with the expression itself. A rule without mandatory trigrams scans every document.

An index block is a slice of documents inside one task, so postings never cross the network and
their size is bounded by the slice, whatever the corpus.

Defined cases: null texts are empty and have no spans; offsets are code points, ends exclusive;
repeated rows are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlab.llm._text import LOWER, slices, utf8

#: A query is None (no demand), a trigram, or ("all" | "any", queries).
MAX_STRINGS = 24


def _join(kind: str, parts: list) -> object:
    """ALL drops parts without a demand; ANY with such a part demands nothing."""
    if kind == "any" and any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: list[bytes]) -> object:
    """The demand that one of these strings occurs."""
    return _join("any", [_join("all", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _lowered(code: int) -> bytes:
    return chr(code).encode().lower() if code < 128 else chr(code).encode()


def _sequence(items) -> tuple[list[bytes] | None, object]:
    """(all strings that the sequence can match, or None if they are not few; demand on any match)."""
    runs, demand = [b""], []

    def close():
        nonlocal runs
        demand.append(_of_strings(runs))
        runs = [b""]

    whole = True
    for op, arg in items:
        exact, need = _one(op, arg)
        demand.append(need)
        if exact is not None and len(runs) * len(exact) <= MAX_STRINGS:
            runs = list(dict.fromkeys(a + b for a in runs for b in exact))
        else:
            whole = False
            close()
            if exact is not None:
                runs = exact
    if whole:
        return runs, _join("all", demand)
    close()
    return None, _join("all", demand)


def _one(op, arg) -> tuple[list[bytes] | None, object]:
    if op is C.LITERAL:
        return [_lowered(arg)], None
    if op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
        return list(dict.fromkeys(_lowered(v) for _, v in arg)), None
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        demand = _join("any", [_join("all", [need, _of_strings(exact) if exact is not None else None]) for exact, need in found])
        strings = [s for exact, _ in found for s in exact] if all(exact is not None for exact, _ in found) else None
        return (strings if strings is not None and len(strings) <= MAX_STRINGS else None), demand
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, body = arg
        exact, need = _sequence(body)
        if exact is not None and high is not C.MAXREPEAT and high <= 4:
            strings = [b""] if low == 0 else []
            power = [b""]
            for n in range(1, high + 1):
                power = [a + b for a in power for b in exact][: MAX_STRINGS + 1]
                strings += power if n >= low else []
            if len(strings) <= MAX_STRINGS:
                return strings, None
        if low == 0:
            return None, None
        power = [b""]
        for _ in range(min(low, 4) if exact is not None else 0):
            power = [a + b for a in power for b in exact][: MAX_STRINGS + 1]
        return None, _join("all", [need, _of_strings(power) if exact is not None and len(power) <= MAX_STRINGS else None])
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return [b""], None
    return None, None


def trigram_query(pattern: str, flags: int = 0) -> object:
    """The Boolean trigram query that every text with a match satisfies; None if there is none."""
    exact, need = _sequence(parser.parse(pattern, flags))
    return _join("all", [need, _of_strings(exact) if exact is not None else None])


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)

    @cached_property
    def query(self) -> object:
        return trigram_query(self.pattern, re.ASCII)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.regex.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: Base rules first; the others add spans of their own kinds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:authorization)\x20*:\x20*(?i:bearer)\x20+[A-Za-z0-9+/_.=-]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,12}://[^\s:@/]{1,64}:[^\s:@/]{4,64}@"),
)


class Index:
    """Posting lists of one block of documents, for the trigrams that the rules ask for."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.trigrams = sorted({t for r in rules for t in self._leaves(r.query)})
        self.number = {t: i for i, t in enumerate(self.trigrams)}
        self.table = np.zeros(1 << 24, np.uint16)  # a trigram's number plus one
        for t, i in self.number.items():
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = i + 1

    @staticmethod
    def _leaves(query) -> list[bytes]:
        return [] if query is None else [query] if isinstance(query, bytes) else [t for q in query[1] for t in Index._leaves(q)]

    def build(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Sorted documents by trigram number."""
        n = len(data) - 2
        if n <= 0:
            return [np.zeros(0, np.int64)] * len(self.trigrams)
        low = LOWER[data].astype(np.int32)
        number = self.table[(low[:n] << 16) | (low[1 : n + 1] << 8) | low[2:]]
        at = np.flatnonzero(number)
        doc = np.searchsorted(off, at, "right") - 1
        inside = at + 3 <= off[doc + 1]
        pairs = np.unique(number[at[inside]].astype(np.int64) * len(off) + doc[inside])
        edge = np.searchsorted(pairs, np.arange(1, len(self.trigrams) + 2) * len(off))
        return [pairs[edge[i] : edge[i + 1]] % len(off) for i in range(len(self.trigrams))]

    def candidates(self, query, postings: list[np.ndarray], docs: int) -> np.ndarray:
        if query is None:
            return np.arange(docs)
        if isinstance(query, bytes):
            return postings[self.number[query]]
        lists = sorted((self.candidates(q, postings, docs) for q in query[1]), key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "all" else np.union1d(out, x)
        return out


def find(column: pa.Array, index: Index) -> list[list[tuple[int, int, int]]]:
    """(start, rule number, end) of all secrets of each text, by start and rule."""
    out: list[list[tuple[int, int, int]]] = []
    for lo, hi, data, off in slices(column):
        postings, texts, found = index.build(data, off), {}, [[] for _ in range(hi - lo)]
        for k, rule in enumerate(index.rules):
            for i in index.candidates(rule.query, postings, hi - lo).tolist():
                if (text := texts.get(i)) is None:
                    text = texts[i] = data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")
                found[i] += [(a, k, b) for a, b in rule.spans(text)]
        out += [sorted(x) for x in found]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """One row per document: id and ``secrets``, an array of (kind, start, end) by start, then rule order."""

    def run(batches):
        index = Index(rules)
        for batch in batches:
            found = find(batch.column("text"), index)
            rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], [id_col, "secrets"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return chosen.mapInArrow(run, T.StructType([T.StructField(id_col, chosen.schema["id"].dataType), T.StructField("secrets", T.ArrayType(span))]))


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE + EXTRA, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, every secret of the text replaced by ``mark``; null texts stay null."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches):
        index = Index(rules)
        for batch in batches:
            column = batch.column(at)
            found, texts = find(column, index), {}
            for i, spans in enumerate(found):
                if spans:
                    text, parts, done = column[i].as_py(), [], 0
                    for a, _, b in spans:
                        if b > done:
                            parts += [text[done:a], mark] if a >= done else []
                            done = b
                    texts[i] = "".join([*parts, text[done:]])
            if texts:
                values = column.to_pylist()
                for i, text in texts.items():
                    values[i] = text
                column = pa.array(values, column.type)
            yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, schema)


def digest(secrets: DataFrame, id_col: str = "doc_id", base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as text."""
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    kinds = [r.kind for r in base]
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    return secrets.select(id_col, *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds), F.sha2(text(F.filter("secrets", lambda s: s["kind"].isin(kinds))), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))


__all__ = ["BASE", "EXTRA", "Index", "Rule", "digest", "find", "redact", "scan", "trigram_query", "utf8"]
