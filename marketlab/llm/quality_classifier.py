"""Quality classifier: logistic regression over hashed word n-grams, fitted by FTRL-proximal updates.

The n-grams of a text are its words, its pairs of adjacent words, and one- and two-grams of word
shapes (case and symbol pattern, and whether a word repeats the one before). Each hashes to a slot;
a slot's value is its count over the number of words, times a constant, so a score is a sparse dot
product. Training walks a bounded sample of labelled documents in hash order; scoring is one pass.

Defined cases: texts without words score from the bias alone; without labels of both kinds every
score is 0.5; repeated rows score alike. Labels, source and language never enter a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlab.llm._text import U64, Words, mix, slices

BITS, SCALE, SAMPLE_DOCS, PASSES = 18, 24.0, 5000, 3
_KIND = np.zeros(256, np.int64)  # of a byte: 0 other, 1 lower, 2 upper, 3 digit, 4 stop, 5 symbol
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[list(b".,;:?!'\"()-")] = 4
_KIND[list(b"#*$%&|<>@^~=+_/\\{}[]`")] = 5
_KIND[128:] = 1


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
    """Slots of all n-grams, one row a kind of n-gram and one column a word (-1: none)."""
    w = Words(data, off)
    h, n = w.hashes(), len(w.start)
    out = np.full((4, n), -1, np.int64)
    if not n:
        return out, w.per_doc, w
    present = np.zeros((5, n), bool)
    for kind in range(1, 6):
        total = np.concatenate([[0], np.cumsum(_KIND[w.data] == kind, dtype=np.int32)])
        count = total[w.end] - total[w.start]
        present[kind - 1] = count > (1 if kind == 2 else 0)
    shape = (present * (1 << np.arange(5))[:, None]).sum(0) + 32 * np.minimum(3, (w.end - w.start) // 5)
    shape = shape + 128 * (np.bincount(np.flatnonzero(np.diff(w.doc) == 0) + 1, minlength=n)[:n] & np.append(False, h[1:] == h[:-1]))
    pair = np.flatnonzero(np.diff(w.doc) == 0)
    mask, s = U64((1 << BITS) - 1), shape.astype(U64)
    out[0] = (h & mask).astype(np.int64)
    out[1, pair] = (mix(h[pair] * U64(3) + h[pair + 1]) & mask).astype(np.int64)
    out[2] = (mix(s + U64(1 << 32)) & mask).astype(np.int64)
    out[3, pair] = (mix((s[pair] << U64(20)) + s[pair + 1] + U64(1 << 40)) & mask).astype(np.int64)
    return out, w.per_doc, w


@dataclass
class Model:
    bias: float
    weights: np.ndarray

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        slots, per_doc, w = features(data, off)
        wide = np.append(self.weights, 0.0)  # slot -1 weighs nothing
        total = np.concatenate([[0.0], np.cumsum(wide[slots].sum(0))])
        return 1 / (1 + np.exp(-np.clip(self.bias + SCALE * np.diff(total[w.first]) / np.maximum(per_doc, 1), -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, passes: int = PASSES) -> Model:
    """Per-coordinate follow-the-regularised-leader over (slots, values) rows; slot 2^BITS is the bias."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(passes):
        for (at, x), y in zip(rows, labels):
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[at] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(float(w[size]), w[:size])


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Rows that no label may be learned from: crc32 of the id as text, divisible by ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on at most ``sample_docs`` labelled documents outside the held-out fold, in hash order."""
    picked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(~held_out("id", folds)).dropDuplicates(["id"]).orderBy(F.xxhash64(F.lit(2), "id"), "id").limit(sample_docs)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")

    def extract(batches):
        for batch in batches:
            for lo, hi, data, off in slices(batch.column("text")):
                slots, per_doc, w = features(data, off)
                at, x = [], []
                for i in range(hi - lo):
                    own = slots[:, w.first[i] : w.first[i + 1]].ravel()
                    slot, count = np.unique(own[own >= 0], return_counts=True)
                    at.append(np.append(slot, 1 << BITS).astype(np.int32).tobytes())
                    x.append(np.append(count * SCALE / max(1, per_doc[i]), 1.0).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), pa.array(at, pa.binary()), pa.array(x, pa.binary())], ["id", "label", "slots", "x"])

    schema = T.StructType([chosen.schema["id"], T.StructField("label", T.IntegerType()), T.StructField("slots", T.BinaryType()), T.StructField("x", T.BinaryType())])
    rows = chosen.mapInArrow(extract, schema).orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(2 * sample_docs).collect()
    y = np.array([r["label"] for r in rows])
    if len(set(y.tolist())) < 2:
        return Model(0.0, np.zeros(1 << BITS))
    return ftrl([(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["x"], np.float32).astype(float)) for r in rows], y)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, ``score`` (0 to 1, higher: better) and ``predicted`` for every document."""
    weights = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS doubles, whatever the input

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in slices(batch.column("text")):
                p = weights.value.scores(data, off)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, T.StructType([T.StructField(id_col, chosen.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
