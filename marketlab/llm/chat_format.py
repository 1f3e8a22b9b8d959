"""Chat formatting of conversations whose turns hold typed content parts.

A visitor walks the parts of a turn (text, image, audio, document) in order and flattens them into one
string: text is escaped, every other part becomes a numbered placeholder, and its reference and
expanded token count are recorded. A template marks turns; text can not forge its control strings,
since they are escaped reversibly. The loss mask covers exactly what assistant turns say.

Turns are partitioned by conversation and sorted there by Spark, so a task streams turns and keeps
only the running offsets of the conversation it is in: a conversation of any length takes bounded
memory. Output is one row per turn; a conversation's formatted text is its rows in order.

Defined cases: null text or parts are empty, null roles are empty strings, unknown part types become
placeholders of their own type with no tokens; repeated rows are kept, in the order (turn, role,
text); null conversation ids form one conversation.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The template's control strings (fixed values of the format); escaped text holds neither [INST], [/INST] nor </s>.
TURN_OPEN, TURN_ROLE_END, TURN_CLOSE = "[INST] ", " [/INST]\n", "</s>\n"
PLACE = "<|{kind}_{n}|>"
_ESCAPED = re.compile(r"([\[<])\\|\\\\")

PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.IntegerType())])


def escape(text: str) -> str:
    """Break every control string by a backslash after its first character; backslashes double."""
    return text.replace("\\", "\\\\").replace("[", "[\\").replace("<", "<\\")


def unescape(text: str) -> str:
    """The inverse: in escaped text a backslash follows every [ and <, and all others are doubled."""
    return _ESCAPED.sub(lambda m: m[1] or "\\", text) if "\\" in text else text


@dataclass
class Flat:
    """What a visit leaves: escaped text with placeholders, attachments, and the tokens they expand to."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0


class Flatten:
    """Visitor of content parts; ``patch``, ``rate`` and ``page_tokens`` size the expanded attachments."""

    def __init__(self, patch: int = 28, rate: float = 25.0, page_tokens: int = 256):
        self.patch, self.rate, self.page_tokens = patch, rate, page_tokens

    def visit(self, parts: list[dict], counts: dict[str, int]) -> Flat:
        """counts: attachments of each type so far in the conversation; advanced here."""
        flat = Flat()
        for part in parts or ():
            kind = (part or {}).get("type") or "text"
            getattr(self, f"visit_{kind}", self.visit_other)(part or {}, kind, flat, counts)
        return flat

    def visit_text(self, part: dict, kind: str, flat: Flat, counts: dict) -> None:
        flat.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict, kind: str, flat: Flat, counts: dict) -> None:
        self._attach(part, kind, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch), flat, counts)

    def visit_audio(self, part: dict, kind: str, flat: Flat, counts: dict) -> None:
        self._attach(part, kind, math.ceil((part.get("seconds") or 0.0) * self.rate), flat, counts)

    def visit_document(self, part: dict, kind: str, flat: Flat, counts: dict) -> None:
        self._attach(part, kind, (part.get("pages") or 0) * self.page_tokens, flat, counts)

    def visit_other(self, part: dict, kind: str, flat: Flat, counts: dict) -> None:
        self._attach(part, "".join(c if c.isalnum() else "_" for c in kind), 0, flat, counts)

    @staticmethod
    def _attach(part: dict, kind: str, tokens: int, flat: Flat, counts: dict) -> None:
        counts[kind] = counts.get(kind, 0) + 1
        mark = PLACE.format(kind=kind, n=counts[kind])
        flat.attachments.append({"placeholder": mark, "type": kind, "ref": part.get("ref"), "tokens": tokens})
        flat.pieces.append(mark)
        flat.tokens += tokens


def render(role: str, flat: Flat) -> tuple[str, int, int]:
    """(formatted turn, start and end of what the turn says in it)."""
    head = f"{TURN_OPEN}{escape(role)}{TURN_ROLE_END}"
    body = "".join(flat.pieces)
    return f"{head}{body}{TURN_CLOSE}", len(head), len(head) + len(body)


def parse(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn, unescaped; placeholders stay as they are written."""
    head = formatted.index(TURN_ROLE_END)
    return unescape(formatted[len(TURN_OPEN) : head]), unescape(formatted[head + len(TURN_ROLE_END) : -len(TURN_CLOSE)])


ATTACHMENT = T.ArrayType(T.StructType([T.StructField("placeholder", T.StringType()), T.StructField("type", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("tokens", T.LongType())]))
_ATTACHMENT = pa.list_(pa.struct([("placeholder", pa.string()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def text_part(text) -> F.Column:
    """A plain text column as a list of one text part."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]]
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *empty))


def format_turns(turns: DataFrame, parts=None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", visitor: Flatten | None = None) -> DataFrame:
    """One row per turn: conv_id, ``seq`` (from 0), ``formatted``, ``char_start`` of it in the conversation,
    ``loss_start`` and ``loss_end`` (in the conversation; null outside assistant turns), ``attachments``, ``expanded_tokens``."""
    visitor = visitor or Flatten()
    chosen = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), (text_part(F.col(text_col).cast("string")) if parts is None else parts).cast(T.ArrayType(PART)).alias("parts"))
    placed = chosen.repartition("conv").sortWithinPartitions("conv", "turn", "role", F.to_json("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seq, at, counts = object(), 0, 0, {}
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in ("seq", "formatted", "char_start", "loss_start", "loss_end", "attachments", "expanded_tokens")}
            for c, role, content in zip(batch.column("conv").to_pylist(), batch.column("role").to_pylist(), batch.column("parts").to_pylist()):
                if c != conv:
                    conv, seq, at, counts = c, 0, 0, {}
                flat = visitor.visit(content, counts)
                text, a, b = render(role, flat)
                loss = role == "assistant"
                for name, value in zip(rows, (seq, text, at, at + a if loss else None, at + b if loss else None, flat.attachments, flat.tokens)):
                    rows[name].append(value)
                seq, at = seq + 1, at + len(text)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), _ATTACHMENT, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *(pa.array(v, k) for v, k in zip(rows.values(), kinds))], [conv_col, *rows])

    long = T.LongType()
    return placed.mapInArrow(run, T.StructType([T.StructField(conv_col, placed.schema["conv"].dataType), T.StructField("seq", long), T.StructField("formatted", T.StringType()), T.StructField("char_start", long), T.StructField("loss_start", long), T.StructField("loss_end", long), T.StructField("attachments", ATTACHMENT), T.StructField("expanded_tokens", long)]))


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of each conversation, parsed from formatted turns alone, as a stream of sorted rows."""
    names = (conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def close() -> list:
            return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]]

        kinds: list = []
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done = []
            for c, text, at, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if state is None or c != state[0]:
                    done += [close()] if state else []
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = parse(text)
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
                if a is not None:
                    learned = unescape(text[a - at : b - at])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done), kinds)], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(close(), kinds)], names)

    placed = formatted.select(conv_col, "seq", "formatted", "char_start", "loss_start", "loss_end").repartition(conv_col).sortWithinPartitions(conv_col, "seq")
    return placed.mapInArrow(run, T.StructType([T.StructField(conv_col, formatted.schema[conv_col].dataType), *(T.StructField(n, T.StringType() if "sha" in n else T.LongType()) for n in names[1:])]))


def conversation(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation: ``formatted`` as a whole, ``loss_spans`` and ``attachments`` in order."""
    rows = F.sort_array(F.collect_list(F.struct("seq", "formatted", "loss_start", "loss_end", "attachments")))
    whole = formatted.groupBy(conv_col).agg(rows.alias("rows"))
    spans = F.transform(F.filter("rows", lambda r: r["loss_start"].isNotNull()), lambda r: F.struct(r["loss_start"].alias("start"), r["loss_end"].alias("end")))
    return whole.select(conv_col, F.concat_ws("", F.transform("rows", lambda r: r["formatted"])).alias("formatted"), spans.alias("loss_spans"), F.flatten(F.transform("rows", lambda r: r["attachments"])).alias("attachments"))
