"""Context-tree weighting over bytes, and a smoothed word model beside it.

A byte is eight binary decisions, each with a context tree of its own over the bytes before it. A node
counts the zeros and ones seen below it and estimates by Krichevsky-Trofimov; its weighted probability is half its own
estimate plus half the product of its children's. Learned once, the tree predicts with the posterior
weight of stopping at each node of the path, mixing all depths. Texts are lower-cased (A-Z), start from
an empty context and close with an end byte (zero).

Counting is an aggregation over all training texts: slices emit distinct (context, byte) and word
counts, tasks merge them, and a shuffle sums them. Node weights follow level by level, deepest first, as
aggregations too. The model that scoring tasks hold is checked: it is broadcast in shards of at most
``shard_bytes``, one scoring pass a shard, split by the two bytes before the one that is predicted, so any model size works.
Word counts are looked up from a broadcast of the most frequent words (at most 2^18); other words join
the count table in a shuffle.

Defined cases: a null text is empty and codes only its end; without training rows all bits cost one
bit; unseen contexts fall back to the shorter ones; repeated rows count and score one by one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marketlab.llm._store import materialize
from marketlab.llm._text import LOWER, U64, Lookup, Words, long, slices

DEPTH, HEAD_WORDS, SHARD_BYTES, FLUSH, SLICE = 4, 1 << 18, 80 << 20, 1 << 20, 1 << 20
GRAM, WORD, ROWS = 0, 1, 2
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def coded(data: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context and byte packed in one integer, document) of every coded position: a text's bytes and its end."""
    n, docs = len(data), len(off) - 1
    doc = np.repeat(np.arange(docs), np.diff(off))
    wide = np.zeros(n + depth * (docs + 1), U64)
    wide[depth + np.arange(n) + depth * doc] = LOWER[data]
    key = wide[depth:].copy()
    for j in range(1, depth + 1):
        key |= wide[depth - j : len(wide) - j] << U64(8 * j)
    owner = np.full(len(key), -1)
    owner[np.arange(n) + depth * doc] = doc
    owner[off[1:] + depth * np.arange(docs)] = np.arange(docs)
    real = owner >= 0
    return key[real], owner[real]


class _Tally:
    """Counts of keys, merged from slice to slice; handed out before they grow past FLUSH."""

    def __init__(self, kind: int):
        self.kind, self.keys, self.counts, self.size = kind, [], [], 0

    def add(self, keys: np.ndarray):
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > FLUSH:
            self._merge()
            if self.size > FLUSH // 2:
                yield from self.out()

    def _merge(self):
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.keys, self.counts, self.size = [keys], [np.bincount(at, np.concatenate(self.counts), len(keys)).astype(np.int64)], len(keys)

    def out(self):
        if self.size:
            self._merge()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(self.size, self.kind, np.int32)), pa.array(self.keys[0].view(np.int64)), pa.array(self.counts[0])], ["kind", "key", "n"])
        self.keys, self.counts, self.size = [], [], 0


def count(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """docs: (text, train). (kind, key, n): (context, byte) pairs, words, and the number of rows."""

    def run(batches):
        grams, words, rows = _Tally(GRAM), _Tally(WORD), 0
        for batch in batches:
            batch = batch.filter(batch.column("train"))
            rows += len(batch)
            for _, _, data, off in slices(batch.column("text")):
                yield from grams.add(coded(data, off, depth)[0])
                yield from words.add(Words(data, off, lower=True).hashes())
        yield from grams.out()
        yield from words.out()
        yield pa.RecordBatch.from_arrays([pa.array([ROWS], pa.int32()), pa.array([0], pa.int64()), pa.array([rows], pa.int64())], ["kind", "key", "n"])

    return docs.select("text", "train").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov block probability of so many zeros and ones."""
    a, b = zeros.astype(float), ones.astype(float)
    return (_lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0)).astype(float) - math.log(math.pi)


def nodes(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(depth, key, one, stop): each node's KT probability of a one, and its posterior weight of stopping.

    A node's key is its context, shifted by a byte, plus the path (1 to 255) through the byte's bits.
    """
    bits = F.explode(F.expr("transform(sequence(0, 7), l -> named_struct('path', shiftleft(1L, l) | shiftright(key & 255L, 8 - l), 'one', shiftright(key & 255L, 7 - l) & 1L))"))
    flat = grams.select("key", "n", bits.alias("bit")).select((F.shiftleft(F.shiftright("key", 8), 8) + F.col("bit.path")).alias("key"), (F.col("n") * F.col("bit.one")).alias("ones"), "n")
    level = flat.groupBy("key").agg(F.sum(F.col("n") - F.col("ones")).alias("zeros"), F.sum("ones").alias("ones"), F.lit(None).cast("double").alias("below"))
    out = None

    def weigh(frames):
        for f in frames:
            zeros, ones, below = (f[c].to_numpy() for c in ("zeros", "ones", "below"))
            own = kt(zeros, ones)
            leaf = np.isnan(below)
            both = np.where(leaf, own, np.logaddexp(own, np.where(leaf, 0.0, below)) - math.log(2))
            stop = np.where(leaf, 1.0, np.exp(np.minimum(0.0, own - math.log(2) - both)))
            yield pd.DataFrame({"key": f["key"], "zeros": zeros, "ones": ones, "weighted": both, "one": (ones + 0.5) / (zeros + ones + 1.0), "stop": stop})

    for d in range(depth, -1, -1):
        level = materialize(level.mapInPandas(weigh, "key long, zeros long, ones long, weighted double, one double, stop double"), f"nodes{d}")
        part = level.select(F.lit(d).alias("depth"), "key", F.col("one").cast("float").alias("one"), F.col("stop").cast("float").alias("stop"))
        out = part if out is None else out.union(part)
        if d:
            shorter = F.col("key").bitwiseAND(F.lit((1 << 8 * d) - 1))  # drops the oldest byte; d - 1 bytes and the path stay
            level = level.groupBy(shorter.alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
    return out


class Tree:
    """Nodes by depth: sorted keys, KT probabilities of a one, and stopping weights."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each byte in its context."""
        g, out = grams.view(np.int64), np.zeros(len(grams))
        byte, context = g & 255, g & ~np.int64(255)
        for l in range(8):
            path, bit = (1 << l) | (byte >> (8 - l)), (byte >> (7 - l)) & 1
            p = np.full(len(g), 0.5)
            for d in range(len(self.levels) - 1, -1, -1):
                key, one, stop = self.levels[d]
                if not len(key):
                    continue
                want = (context & ((1 << 8 * (d + 1)) - 1)) + path
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                found = key[at] == want
                q = np.where(bit == 1, one[at], 1.0 - one[at])
                p = np.where(found, stop[at] * q + (1.0 - stop[at]) * p, 0.5)
            out += np.log10(p)
        return out


def _shard(key, shards: int):
    """Shard of a context and byte, or of a node, by the context's last two bytes; key: array or column."""
    last = F.shiftright(key, 8).bitwiseAND(F.lit(65535)) if isinstance(key, Column) else (key >> 8) & 65535
    return (last * 40503 % 65536) % shards


def byte_logs(keys: DataFrame, tree: DataFrame, depth: int = DEPTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, log10) of each (context, byte) key: tasks hold one shard of the tree at a time."""
    shards = -(-16 * tree.count() // shard_bytes) or 1
    out = None
    for k in range(shards):
        part = _load(tree.where((F.col("depth") < 2) | (_shard(F.col("key"), shards) == k)).orderBy("depth", "key"))
        edges = np.searchsorted(part["depth"], np.arange(depth + 2))
        levels = keys.sparkSession.sparkContext.broadcast([tuple(part[c][a:b] for c in ("key", "one", "stop")) for a, b in zip(edges[:-1], edges[1:])])

        def run(batches, levels=levels):
            model = Tree(levels.value)
            for batch in batches:
                key = batch.column("key").to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(model.log10(key.view(U64)).astype(np.float32))], ["key", "log10"])

        found = keys.where(_shard(F.col("key"), shards) == k).mapInArrow(run, "key long, log10 float")
        out = found if out is None else out.union(found)
    return out


def _load(table: DataFrame) -> dict[str, np.ndarray]:
    """A table of checked size, as arrays."""
    frame = table.toArrow()
    return {n: frame.column(n).to_numpy() for n in frame.column_names}


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, shard_bytes: int = SHARD_BYTES, head_words: int = HEAD_WORDS) -> DataFrame:
    """One row per row of docs: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``.

    train: Column, true for rows to learn from.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), train.alias("train"))
    counts = materialize(count(rows, depth), "counts")
    totals = {r["kind"]: (r["entries"], r["n"]) for r in counts.groupBy("kind").agg(F.count("*").alias("entries"), F.sum("n").alias("n")).collect()}
    ends = totals[ROWS][1] if ROWS in totals else 0
    distinct, tokens = totals.get(WORD, (0, 0))
    distinct, tokens = distinct + (ends > 0), tokens + ends
    below = tokens + 0.1 * (distinct + 1)

    words = counts.where(F.col("kind") == WORD).select("key", F.col("n").alias("c"))
    # The least power of two that at most head_words words reach; powers are few, words are not.
    powers = words.groupBy(F.floor(F.log2("c")).cast("int").alias("p")).agg(F.count("*").alias("n")).orderBy(F.desc("p")).collect()
    floor, room = 62, head_words
    for r in powers:
        room -= r["n"]
        if room < 0:
            break
        floor = r["p"]
    head = _load(words.where(F.col("c") >= (1 << floor)))
    heads = spark.sparkContext.broadcast((head["key"].view(np.uint64), np.log10((head["c"] + 0.1) / below)))
    end_score = math.log10((ends + 0.1) / below)

    grams = counts.where(F.col("kind") == GRAM).select("key", "n")
    tree = materialize(nodes(grams, depth), "tree")
    logs = materialize(byte_logs(grams.select("key"), tree, depth, shard_bytes), "logs")
    shards = -(-12 * totals.get(GRAM, (0, 0))[0] // shard_bytes) or 1
    scored = None
    for k in range(shards):
        part = _load(logs.where(_shard(F.col("key"), shards) == k))
        grams_k = spark.sparkContext.broadcast((part["key"].view(np.uint64), part["log10"]))
        part = rows.mapInArrow(_scorer(rows, depth, shards, k, grams_k, heads, end_score, ends > 0), _schema(rows))
        scored = part if scored is None else scored.union(part)
    scored = materialize(scored, "scored")
    whole = scored.where("kind is null")
    if shards > 1:
        whole = whole.groupBy("row").agg(*(F.max(c).alias(c) for c in ("id", "held_out", "n_tokens", "known", "base", "bytes")), F.sum("score").alias("score"))
    tail = scored.where(F.col("kind") == WORD).select("row", "key", "times").join(words, "key", "left")
    tail = tail.groupBy("row").agg(F.sum(F.col("times") * F.col("c").isNotNull().cast("long")).alias("more_known"), F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.1)) / F.lit(below))).alias("more_base"))
    # Bytes never seen in their context are few; their probabilities come from the tree itself.
    new = scored.where(F.col("kind") == GRAM).select("row", "key", "times")
    new = new.join(byte_logs(new.select("key").distinct(), tree, depth, shard_bytes), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("log10")).alias("more_score"))
    both = whole.join(tail, "row", "left").join(new, "row", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    return both.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") / F.lit(math.log10(2)) / (F.col("bytes") + 1)).alias("bits_per_byte"),
    )


def _schema(rows: DataFrame) -> T.StructType:
    long_, double = T.LongType(), T.DoubleType()
    return T.StructType([T.StructField(n, t) for n, t in (("row", long_), ("id", rows.schema["id"].dataType), ("held_out", T.BooleanType()), ("n_tokens", long_), ("known", long_), ("base", double), ("bytes", long_), ("score", double), ("kind", T.IntegerType()), ("key", long_), ("times", long_))])


def _scorer(rows, depth, shards, k, grams_k, heads, end_score, end_known):
    id_type = to_arrow_type(rows.schema["id"].dataType)
    names = [f.name for f in _schema(rows)]

    def apart(kind: int, row: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        """Rows for keys that are not at hand: each distinct one of a row, with its count."""
        order = np.lexsort((key, row))
        key, row = key[order], row[order]
        fresh = np.flatnonzero(np.append(len(key) > 0, (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
        n = len(fresh)
        empty = [pa.nulls(n, t) for t in (id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64())]
        return pa.RecordBatch.from_arrays([long(row[fresh]), *empty, pa.array(np.full(n, kind, np.int32)), pa.array(key[fresh].view(np.int64)), long(np.diff(np.append(fresh, len(key))))], names)

    def run(batches):
        (keys, logs), (head_keys, head_logs) = grams_k.value, heads.value
        find, find_head = Lookup(keys), Lookup(head_keys)
        logs = np.append(logs.astype(float), 0.0)  # -1: not at hand
        for batch in batches:
            ids = batch.column("row").to_numpy()
            for lo, hi, data, off in slices(batch.column("text"), SLICE):
                m = hi - lo
                key, doc = coded(data, off, depth)
                if shards > 1:
                    own = _shard(key.view(np.int64), shards) == k
                    key, doc = key[own], doc[own]
                at = find(key)
                total = np.bincount(doc, logs[at], m)
                if (at < 0).any():
                    yield apart(GRAM, ids[lo + doc[at < 0]], key[at < 0])
                w = Words(data, off, lower=True)
                h = w.hashes()
                spot = find_head(h)
                known = spot >= 0
                base = np.bincount(w.doc[known], head_logs[spot[known]], m) + end_score
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, m), batch.column("id").slice(lo, m), pa.array(~batch.column("train").slice(lo, m).to_numpy(zero_copy_only=False)), long(w.per_doc + 1), long(np.bincount(w.doc[known], minlength=m) + end_known), pa.array(base), long(np.diff(off)), pa.array(total), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names)
                if k == 0 and not known.all():
                    yield apart(WORD, ids[lo + w.doc[~known]], h[~known])

    return run
