"""N-gram Jaccard join with set-relation skipping, and the components of its links.

A document is the set of its distinct word shingles. Two documents link when their sets' Jaccard
similarity reaches ``percent``. Work goes in steps, none of which loses a link:

1. One pass fingerprints every set (equal sets form one class, whose copies need no pairs), keeps a
   parity bitmap of each, and counts shingles into a sketch of fixed size.
2. Shingles are ordered rare first by the sketch. Any two similar sets share ``LEVEL`` shingles among
   the first n - ceil(t n) + LEVEL of each, so only those prefixes enter index lists.
3. Index lists are sorted by set size and position, and blocks of entries that share both are skipped or taken
   as a whole: short lists emit the pairs of blocks whose sizes and positions can still reach the overlap; a pair needs
   LEVEL common lists. Long lists are compared block by block by bitmaps, whose distance bounds the overlap from above,
   and emit a spanning forest of what is left.
4. Components of these candidates are groups. In a group a few sets are probed in full against an index of the
   group's shingles, whose lists are skipped to the sizes that can link. The answer of a set that is highly similar to a
   probed one (its overlaps with all sets) is derived from that answer: lists of the shingles that only one of both has are
   subtracted and added. Sets of the largest component need no answer of their own, as any other link has an end outside it.
   Large groups are dealt out in pairs of blocks.
5. Links that hold form the components; their names are least document ids.

Defined cases: null or empty texts (no words) have empty sets that link with nothing; texts with fewer
words than a shingle are one shingle; repeated rows share a class; all rows are returned once each; texts under one id are sets of
their own; a null id counts after all others and names a class only where no other id does.
Shingles and sets are identified by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marketlab.llm._graph import components
from marketlab.llm._store import materialize
from marketlab.llm._text import U64, Words, mix, slices

SHINGLE, PERCENT, LEVEL = 5, 80, 3
SKETCH_BITS, SKETCH_BLOCKS = 21, 32
LONG_LIST, LIST_BLOCK, GROUP_BYTES, PROBE_ROWS, PIVOTS, BROADCAST_ROWS = 32, 4096, 8 << 20, 4 << 20, 16, 1 << 20
_I64 = np.int64


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every document, sorted within it, and the offsets of documents among them."""
    w = Words(data, off, lower=True)
    at, window = w.windows(w.hashes(), k)
    doc = w.doc[at]
    few = np.flatnonzero((w.per_doc > 0) & (w.per_doc < k))
    if len(few):
        h, extra = w.hashes(), []
        for i in few.tolist():
            v = np.array([w.per_doc[i]], U64)
            for j in range(w.first[i], w.first[i + 1]):
                v = mix(v * U64(31) + h[j : j + 1])
            extra.append(v[0])
        window, doc = np.concatenate([window, np.array(extra, U64)]), np.concatenate([doc, few])
    order = np.lexsort((window, doc))
    window, doc = window[order], doc[order]
    fresh = np.ones(len(window), bool)
    fresh[1:] = (window[1:] != window[:-1]) | (doc[1:] != doc[:-1])
    window, doc = window[fresh], doc[fresh]
    return window, np.searchsorted(doc, np.arange(len(off)))


def set_keys(window: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A fingerprint of each set."""
    total = np.zeros(len(window) + 1, U64)
    np.cumsum(mix(window ^ U64(0x5851F42D4C957F2D)), out=total[1:])
    n = np.diff(edges).astype(U64)
    return mix(total[edges[1:]] - total[edges[:-1]] + n * U64(0x2545F4914F6CDD1D)).view(_I64)


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens of each residue; as many bits as tokens, rounded up to a power of two."""
    bits = 1 << max(6, int(len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens & U64(bits - 1)).astype(_I64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def least_overlap(total: np.ndarray | int, percent: int = PERCENT):
    """Least intersection of two sets of ``total`` elements together for 100 I >= percent (total - I)."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return np.minimum(n, n - -(-percent * n // 100) + LEVEL)


def _summaries(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(id, tag, key, n, bits) of every row, and the class of rarity of each sketch cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, _I64)
        for batch in batches:
            for lo, hi, data, off in slices(batch.column("text")):
                window, edges = shingle_sets(data, off)
                cells += np.bincount((window >> U64(64 - SKETCH_BITS)).astype(_I64), minlength=len(cells))
                bits = [bitmap(window[a:b]) if b > a else b"" for a, b in zip(edges[:-1], edges[1:])]
                m = hi - lo
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, m), batch.column("tag").slice(lo, m), pa.array(set_keys(window, edges)), pa.array(np.diff(edges).astype(_I64)), pa.array(bits, pa.binary()), pa.nulls(m, pa.int32())], names)
        if cells.any():
            m = SKETCH_BLOCKS
            parts = [p.tobytes() for p in cells.astype(np.uint32).reshape(m, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(m, id_type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(parts, pa.binary()), pa.array(np.arange(m, dtype=np.int32))], names)

    id_type = to_arrow_type(docs.schema["id"].dataType)
    names = ["id", "tag", "key", "n", "bits", "block"]
    schema = T.StructType([docs.schema["id"], T.StructField("tag", T.LongType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("block", T.IntegerType())])
    table = materialize(docs.mapInArrow(run, schema), "sets")

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, bits in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist()):
                x = np.frombuffer(bits, np.uint32).astype(_I64) if len(bits) == 4 * width else np.frombuffer(bits, _I64)
                total[k] = total.get(k, 0) + x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "bits"])

    def rarities(batches):
        for batch in add(batches):
            for k, bits in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist()):
                cells = np.maximum(np.frombuffer(bits, _I64), 1)
                level = np.clip(np.floor(2 * np.log2(cells / (2.0 * max(1.0, mean)))) + 1, 0, 15).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "bits"])

    # Sums stream through two levels, by part of a block and by block; a task holds one array a block, and the driver gets a byte a cell.
    width = (1 << SKETCH_BITS) // SKETCH_BLOCKS
    mean = (table.agg(F.sum("n")).first()[0] or 0) / (1 << SKETCH_BITS)
    sketch = table.where("block is not null").select("block", "bits")
    parts = sketch.repartition("block", F.pmod(F.xxhash64("bits"), F.lit(SKETCH_BLOCKS))).mapInArrow(add, "block int, bits binary")
    rarity = np.zeros((SKETCH_BLOCKS, width), np.uint8)
    for r in parts.repartition("block").mapInArrow(rarities, "block int, bits binary").collect():  # a fixed number of fixed-size blocks
        rarity[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return table.where("block is null").select("id", "tag", "key", "n", "bits"), rarity.ravel()


def _postings(docs: DataFrame, rarity: np.ndarray) -> DataFrame:
    """(token, key, n, pos) of the prefix of every distinct set of a slice; tokens sort rare first."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)  # 2^SKETCH_BITS bytes, whatever the input

    def run(batches):
        for batch in batches:
            for _, _, data, off in slices(batch.column("text")):
                window, edges = shingle_sets(data, off)
                n = np.diff(edges)
                keys = set_keys(window, edges)
                first = np.zeros(len(keys), bool)
                first[np.unique(keys, return_index=True)[1]] = True
                doc = np.repeat(np.arange(len(n)), n)
                level = shared.value[(window >> U64(64 - SKETCH_BITS)).astype(_I64)]
                token = (level.astype(U64) << U64(59)) | (window >> U64(5))
                order = np.lexsort((token, doc))
                token = token[order]
                pos = np.arange(len(token)) - edges[:-1][doc]
                take = (pos < prefix_length(n)[doc]) & first[doc]
                d = doc[take]
                yield pa.RecordBatch.from_arrays([pa.array(token[take].view(_I64)), pa.array(keys[d]), pa.array(n[d].astype(np.int32)), pa.array(pos[take].astype(np.int32))], ["token", "key", "n", "pos"])

    return docs.select("text").mapInArrow(run, "token long, key long, n int, pos int")


def _runs(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Batches of sorted rows, cut so that a run of equal names is whole unless it is longer than LONG_LIST."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
        key = cols[0]
        cut = int(np.searchsorted(key, key[-1], "left"))
        if len(key) - cut > 4 * LONG_LIST:
            cut = len(key) - 2 * LONG_LIST  # the rest still counts as long
        if cut:
            yield [c[:cut] for c in cols]
        held = [c[cut:] for c in cols]
    if held is not None and len(held[0]):
        yield held


def _lists(postings: DataFrame) -> DataFrame:
    """From index lists: pairs (a, b, need) of short ones, and members (token, a) of long ones."""
    placed = postings.repartition("token").sortWithinPartitions("token", "n", "pos", "key")

    def run(batches):
        for token, key, n, pos in _runs(batches, "token"):
            # Copies of one set from several slices stand side by side.
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            long_run = np.zeros(len(token), bool)
            start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(start, len(token)))
            long_run[:] = np.repeat(size > LONG_LIST, size)
            keep = fresh & long_run
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.nulls(int(keep.sum()), pa.int64()), pa.array(token[keep]), pa.nulls(int(keep.sum()), pa.int32())], names)
            pick = fresh & ~long_run
            t, k, m, p = token[pick], key[pick], n[pick].astype(_I64), pos[pick].astype(_I64)
            a_out, b_out, need_out = [], [], []
            # Blocks of entries of one list that share size and position: what rules out two of them rules out all their pairs.
            head = np.flatnonzero(np.append(len(t) > 0, (t[1:] != t[:-1]) | (m[1:] != m[:-1]) | (p[1:] != p[:-1]))[: len(t)])
            many = np.diff(np.append(head, len(t)))
            for step in range(LONG_LIST):
                x = np.arange(max(0, len(head) - step))
                x = x[t[head[x]] == t[head[x + step]]]
                if not len(x):
                    break
                y = x + step
                (mx, px), (my, py) = ((m[head[z]], p[head[z]]) for z in (x, y))
                need = least_overlap(mx + my)
                fit = (100 * mx >= PERCENT * my) & (np.minimum(mx - px, my - py) >= need - np.minimum(px, py)) & ((step > 0) | (many[x] > 1))
                x, y, need = x[fit], y[fit], np.minimum(need[fit], LEVEL)
                pairs = many[x] * many[y]
                of = np.repeat(np.arange(len(x)), pairs)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
                i, j = head[x[of]] + nth // many[y[of]], head[y[of]] + nth % many[y[of]]
                if step == 0:
                    i, j, of = i[i < j], j[i < j], of[i < j]
                a_out.append(np.minimum(k[i], k[j]))
                b_out.append(np.maximum(k[i], k[j]))
                need_out.append(need[of])
            if a_out:
                a, b, need = np.concatenate(a_out), np.concatenate(b_out), np.concatenate(need_out)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.array(need.astype(np.int32))], names)

    names = ["a", "b", "token", "need"]
    return placed.mapInArrow(run, "a long, b long, token long, need int")


def _bits(maps, width: int) -> np.ndarray:
    """Bitmaps of one width, wider ones folded; narrower ones can't occur."""
    out = np.zeros((len(maps), width // 64), np.uint64)
    for i, b in enumerate(maps):
        x = np.frombuffer(b, np.uint64)
        while len(x) * 64 > width:
            # packbits puts residue r at bit r of the stream, so halves of the stream are residues r and r + half
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def _forest(left: pd.DataFrame, right: pd.DataFrame | None) -> list[tuple[int, int]]:
    """Spanning forest of pairs that bitmaps do not rule out, within one block or between two.

    Sets that already share a component inherit its answer: their pairs are not compared.
    """
    left = left.sort_values("n")
    base = 0 if right is None else len(left)
    right = left if right is None else right.sort_values("n")
    rn, rk = right["n"].to_numpy(), right["key"].to_numpy()
    label = np.arange(base + len(right))
    widths: dict[int, tuple[int, np.ndarray]] = {}
    edges = []
    for i, (k, n, b) in enumerate(zip(left["key"].tolist(), left["n"].tolist(), left["bits"])):
        lo, hi = int(np.searchsorted(rn, -(-PERCENT * n // 100))), int(np.searchsorted(rn, 100 * n // PERCENT, "right"))
        at = lo + np.flatnonzero(label[base + lo : base + hi] != label[i])
        if not len(at):
            continue
        # The narrowest bitmap in reach of this set gives the common width.
        width = min(len(b) * 8, 1 << max(6, int(rn[lo] - 1).bit_length()))
        if width not in widths:
            first = int(np.searchsorted(rn, width // 2, "right")) if width > 64 else 0
            widths[width] = first, _bits(right["bits"].iloc[first:], width)
        first, table = widths[width]
        apart = np.bitwise_count(table[at - first] ^ _bits([b], width)[0]).sum(1, dtype=np.int64)
        total = n + rn[at]
        for j in at[total - apart >= 2 * least_overlap(total)].tolist():
            if label[base + j] != label[i]:
                label[label == label[base + j]] = label[i]
                edges.append((k, int(rk[j])))
    return edges


def _dealt(rows: DataFrame, group: str, weight, limit: int) -> DataFrame:
    """Columns to group by: small groups share buckets of about ``limit``; a large one is dealt into pairs of blocks."""
    sums = materialize(rows.groupBy(group).agg(F.sum(weight).alias("w")), "sizes")
    total, large = sums.agg(F.coalesce(F.sum("w"), F.lit(0)), F.count(F.when(F.col("w") > limit, 1))).first()
    sizes = sums.where(F.col("w") > limit).select(group, F.ceil(F.col("w") / limit).cast("int").alias("blocks"))
    if large <= BROADCAST_ROWS:  # so that a large group's rows need not meet in one task
        sizes = F.broadcast(sizes)
    dealt = rows.join(sizes, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(9), "key"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
    bucket = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(F.lit(8), group), F.lit(int(total // limit) + 1)))
    return dealt.withColumns({"pair": F.explode(pairs), "bucket": bucket, "large": F.when(F.col("blocks") > 1, F.col(group))}).drop("blocks")


BUCKET = ("bucket", "large", "pair")


def _candidates(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) between keys such that similar sets are connected."""
    lists = materialize(_lists(postings), "lists")
    pairs = lists.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("need").alias("need")).where("shared >= need").select("a", "b")
    # A key has one row here, so long lists gain no rows; the hot side is split by the join.
    members = lists.where("b is null").select("token", F.col("a").alias("key")).distinct().join(sets, "key")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        edges = []
        for _, rows in frame.groupby("token"):
            x, y = rows["x"].iloc[0], rows["y"].iloc[0]
            edges += _forest(rows[rows["block"] == x], None if x == y else rows[rows["block"] == y])
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    dealt = _dealt(materialize(members, "members"), "token", F.lit(1), LIST_BLOCK).withColumns({"x": F.col("pair.x"), "y": F.col("pair.y")})
    forest = dealt.groupBy(*BUCKET).applyInPandas(compare, "a long, b long").distinct()
    return pairs.union(forest)


def _true_links(keys: np.ndarray, tokens: list[np.ndarray], block: np.ndarray, x: int, y: int) -> list[tuple[int, int]]:
    """Spanning forest of the links of one group (or between two of its blocks)."""
    n = np.array([len(t) for t in tokens])
    order = np.argsort(n, kind="stable")
    keys, tokens, block, n, many = keys[order], [tokens[i] for i in order], block[order], n[order], len(n)
    doc = np.repeat(np.arange(many), n)
    flat, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(n)])
    # All lists one after the other, each by rising size.
    entry = np.sort(inverse * many + doc)
    listed, length = entry % many, np.bincount(inverse)
    popular = np.add.reduceat(length[inverse], at[:-1]) / n
    label = np.arange(many)
    edges: list[tuple[int, int]] = []
    answers: list[tuple[np.ndarray, np.ndarray]] = []

    def overlaps(own: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """How many of own each set has, read from the part of every list that holds sets lo to hi."""
        out = np.zeros(many, np.int64)
        begin = np.searchsorted(entry, own * many + lo)
        lengths = np.searchsorted(entry, own * many + hi) - begin
        for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(np.cumsum(lengths) // PROBE_ROWS)) + 1):
            size = lengths[part]
            places = np.repeat(begin[part] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            out += np.bincount(listed[places], minlength=many)
        return out

    def probe(i: int, pivot: bool) -> None:
        own = inverse[at[i] : at[i + 1]]
        lo, hi = int(np.searchsorted(n, -(-PERCENT * n[i] // 100))), int(np.searchsorted(n, 100 * n[i] // PERCENT, "right"))
        if pivot:
            overlap = overlaps(own, 0, many)
            if len(answers) < PIVOTS:
                answers.append((own, overlap))
        else:
            near, answer = max(answers, key=lambda a: a[1][i])
            gone, new = np.setdiff1d(near, own, assume_unique=True), np.setdiff1d(own, near, assume_unique=True)
            if len(gone) + len(new) < len(own):
                overlap = answer - overlaps(gone, lo, hi) + overlaps(new, lo, hi)
            else:
                overlap = overlaps(own, lo, hi)
        link = (100 * overlap >= PERCENT * (n + n[i] - overlap)) & ((block != block[i]) | (x == y)) & (label != label[i])
        link[:lo] = link[hi:] = False
        for j in np.flatnonzero(link).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                edges.append((int(keys[i]), int(keys[j])))

    todo = np.argsort(-popular, kind="stable")
    pivots = todo[: max(1, len(todo) // 64)]
    for i in pivots.tolist():
        probe(i, True)
    # Sets of the largest component inherit its answers: any other link has an end outside it, and that end is probed.
    outside = label != np.bincount(label).argmax()
    outside[pivots] = False
    for i in todo[outside[todo]].tolist():
        probe(i, False)
    return edges


def _links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """True edges (a, b) within groups; members: (id, tag, key, component)."""
    named = docs.join(members.where("id is not null").drop("tag").hint("shuffle_hash"), "id").select("key", "component", "text")
    # A set that only rows without an id have is found by its text, of which one row is enough.
    nameless = docs.where("id is null").dropDuplicates(["tag"]).join(members.where("id is null").drop("id"), "tag").select("key", "component", "text")
    dealt = _dealt(materialize(named.unionByName(nameless), "members"), "component", F.octet_length("text"), GROUP_BYTES).withColumns({"x": F.col("pair.x"), "y": F.col("pair.y")})

    def check(frame: pd.DataFrame) -> pd.DataFrame:
        edges = [e for _, rows in frame.groupby("component") for e in check_group(rows)]
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    def check_group(frame: pd.DataFrame) -> list[tuple[int, int]]:
        texts = pa.array(frame["text"], pa.large_string())
        keys, tokens, block = [], [], []
        for lo, hi, data, off in slices(texts):
            window, edges = shingle_sets(data, off)
            own = set_keys(window, edges)
            for i in range(hi - lo):
                if own[i] == frame["key"].iloc[lo + i] and edges[i + 1] > edges[i]:  # an id may stand for several texts
                    keys.append(own[i])
                    tokens.append(window[edges[i] : edges[i + 1]])
                    block.append(frame["block"].iloc[lo + i])
        _, first = np.unique(np.array(keys, _I64), return_index=True)
        if len(first) < 2:
            return []
        return _true_links(np.array(keys)[first], [tokens[i] for i in first], np.array(block)[first], frame["x"].iloc[0], frame["y"].iloc[0])

    return dealt.groupBy(*BUCKET).applyInPandas(check, "a long, b long").distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tag (a hash of the text), n, component (a key that tells components without any id apart) and component_id of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    sets, rarity = _summaries(rows)
    distinct = materialize(sets.where("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.min("tag").alias("tag"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")
    edges = _candidates(_postings(rows, rarity), distinct.select("key", "n", "bits"))
    groups = materialize(components(edges).withColumnRenamed("node", "key"), "groups")
    members = distinct.select("id", "tag", "key").join(groups, "key")
    true = components(_links(rows, members))
    named = distinct.select("key", "id").join(true, distinct["key"] == true["node"], "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    answer = named.select("key", "component").join(least, "component").select("key", "component", "component_id")
    answer = materialize(answer, "answer")
    out = sets.join(answer, sets["key"] == answer["key"], "left")
    return out.select("id", "tag", "n", "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, ``n_shingles`` and ``component_id``, the least id that its links reach."""
    return _classes(docs, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _unused(name: str, columns: list[str]) -> str:
    while name in columns:
        name = f"_{name}"
    return name


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component (a row of the id that names it), and all without words, columns as they were; rows that repeat id and text go."""
    lead, tag, own = (_unused(c, docs.columns) for c in ("_lead", "_tag", "_own_tag"))
    named = _classes(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("component_id")))
    first = named.where("n > 0").groupBy("component").agg(F.min(F.struct("id", "tag")).alias("row")).select("row.*")
    leads = first.unionByName(named.where("n = 0").select("id", "tag")).select(F.col("id").alias(lead), F.col("tag").alias(tag)).distinct()
    tagged = docs.withColumn(own, F.xxhash64(F.col(text_col).cast("string")))
    kept = tagged.join(leads, F.col(id_col).eqNullSafe(F.col(lead)) & (F.col(own) == F.col(tag)), "left_semi")
    return kept.dropDuplicates([id_col, own]).drop(own)
