"""Substring dedup by prefix-partitioned suffix trees: words covered by a window that also starts in a document with a smaller id go.

A repeated window is an internal node of the suffix tree over words, ``window`` words deep. The tree is built
in parts, sparse in its suffixes and partitioned by prefixes of variable length:

1. Sparse suffixes. Of the PREFIX-word prefixes inside every window the one of least fingerprint is
   chosen, so equal windows choose the same one at the same place. A prefix that occurs once has no
   internal node below it: its suffix goes, after one narrow shuffle.
2. Leaves that are equal. Suffixes whose windows are all the same word for word (copies, whole passages) are settled by one
   fingerprint: the least document's stay, the others' windows go. So is a prefix below which nothing else is left.
3. Each suffix left carries its first DEPTH words and the words before it that its windows need. Suffixes
   are grouped by their prefix. A prefix with more than GROUP_ROWS suffixes is extended, on both sides, to the whole
   windows of its suffixes, which are settled in a stream of sorted rows and need no tree.
4. Every other group fits memory: its suffixes are sorted, common-prefix lengths of neighbours give the
   subtree's internal nodes at every depth, and a window (l words before the suffix, the rest after it) is
   repeated if a node of the rest's depth holds several suffixes with equal l words before them. The least
   document of such a node keeps the window. repeats() reads maximal repeats from the same nodes.

Before a shuffle a slice settles what it can by itself: of a frequent prefix it sends one row, and of equal suffixes
only the least document's, so one very common passage costs rows in proportion to the slices. Whole windows are
settled by (window, salt) first and then, for the few left, by window, so a hot one is not one task's.

Defined cases: null texts have no words; texts shorter than a window lose nothing; windows repeated only
within one document, or in rows that share one id, stay; rows are told apart by id and text, so texts under one id
lose only their own words; rows without an id lose nothing and take nothing; ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm._store import materialize
from marketlab.llm._text import U64, Words, long, mix, slices

WINDOW, PREFIX, DEPTH, GROUP_ROWS = 13, 5, 16, 1 << 15
_Q, _R = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def anchors(w: Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, its fingerprint, first word of the prefix it chooses, that prefix's fingerprint)."""
    h = w.hashes()
    start, whole = w.windows(h, window)
    if not len(start):
        return start, whole, start, whole
    short = np.full(len(h), np.iinfo(np.uint64).max, U64)
    at, v = w.windows(h, prefix)
    short[at] = v
    best, place = short[start].copy(), start.copy()
    for j in range(1, window - prefix + 1):
        other = short[start + j]
        less = other < best  # the leftmost of equal ones stays
        best[less], place[less] = other[less], start[less] + j
    return start, whole, place, best


def _suffixes(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """(key, row, at) of chosen suffixes. at: four times the word, plus 2 if the slice has the prefix more than once, plus 1 if the row stands for its prefix."""

    def run(batches):
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for lo, _, data, off in slices(batch.column("text")):
                w = Words(data, off)
                _, _, place, key = anchors(w, window, prefix)
                place, first = np.unique(place, return_index=True)
                key = key[first]
                row = rows[lo + w.doc[place]] if len(place) else np.zeros(0, np.int64)
                at = place - w.first[w.doc[place]] if len(place) else place
                _, head, count = np.unique(key, return_index=True, return_counts=True)
                heads = np.zeros(len(key), bool)
                heads[head] = True
                sure = ~heads
                sure[head[count > 1]] = True
                # Of a frequent prefix the first suffix stands for all under the prefix; the others pass on by themselves.
                key = np.where(heads, key.view(np.int64), mix(row.view(U64) * _Q + at.astype(U64)).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(row), pa.array((4 * at + 2 * sure + heads).astype(np.int32))], ["key", "row", "at"])

    return docs.mapInArrow(run, "key long, row long, at int")


def _shared(suffixes: DataFrame) -> DataFrame:
    """(row, at) of suffixes whose prefix occurs again; rows are sorted by key, and one is held back from batch to batch."""

    def run(batches):
        held, was = None, None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
            key, row, at = cols
            if len(key):
                same = np.append(was is not None and key[0] == was, key[1:] == key[:-1])
                keep = (at[:-1] & 2 > 0) | ((at[:-1] & 1 > 0) & (same[:-1] | same[1:]))
                yield pa.RecordBatch.from_arrays([pa.array(row[:-1][keep]), pa.array(at[:-1][keep] >> 2)], ["row", "at"])
                held, was = [c[-1:] for c in cols], key[-2] if len(key) > 1 else was
        if held is not None:
            key, row, at = held
            keep = (at & 2 > 0) | ((at & 1 > 0) & (was is not None and key[0] == was))
            yield pa.RecordBatch.from_arrays([pa.array(row[keep]), pa.array(at[keep] >> 2)], ["row", "at"])

    return suffixes.repartition("key").sortWithinPartitions("key").mapInArrow(run, "row long, at int")


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of list values (null: 0), and all their elements."""
    return np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64), column.flatten()


def _bytes(rows: np.ndarray) -> pa.Array:
    """A binary value a row."""
    data = np.ascontiguousarray(rows).view(np.uint8)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (data.shape[1] if len(rows) else 0)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _marked(w: Words, window: int, prefix: int, places: pa.Array) -> tuple[np.ndarray, ...]:
    """Of the suffixes at the given words of each document: their first words, documents, prefixes, and first and last windows with fingerprints."""
    start, whole, place, key = anchors(w, window, prefix)
    mark = np.zeros(len(w.start) + 1, bool)
    count, flat = _lists(places)
    mark[np.repeat(w.first[:-1], count) + flat.to_numpy(zero_copy_only=False)] = True
    first = np.flatnonzero(np.append(len(place) > 0, place[1:] != place[:-1])[: len(place)])  # windows of one suffix follow each other
    last = np.append(first[1:], len(place))[: len(first)] - 1
    keep = mark[place[first]]
    first, last = first[keep], last[keep]
    return place[first], w.doc[place[first]] if len(first) else first, key[first], start[first], start[last], whole[first], whole[last]


def _leaves(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """One row for each suffix in column ``places``: print (a fingerprint of all words of its windows), key, id, row, at, span, settled.

    span: 64 times the least, plus the largest, number of words by which its windows begin before it. settled: its slice has the
    same words in a smaller document.
    """

    def run(batches):
        for batch in batches:
            ids, rows = (batch.column(n).to_numpy() for n in ("id", "row"))
            for lo, hi, data, off in slices(batch.column("text")):
                w = Words(data, off)
                p, doc, key, begin, end, head, tail = _marked(w, window, prefix, batch.column("places").slice(lo, hi - lo))
                span = 64 * (p - end) + p - begin
                print_ = mix(head * _Q + mix(tail + span.astype(U64)))
                id_ = ids[lo + doc]
                order = np.lexsort((id_, print_))
                fresh = np.append(len(order) > 0, print_[order[1:]] != print_[order[:-1]])[: len(order)]
                settled = np.zeros(len(p), bool)
                settled[order] = id_[order] > id_[order[fresh]][np.cumsum(fresh) - 1]
                # Settled rows need no company: they are spread by themselves.
                print_ = np.where(settled, mix(rows[lo + doc].view(U64) + p.astype(U64) * _Q), print_)
                yield pa.RecordBatch.from_arrays([pa.array(print_.view(np.int64)), pa.array(key.view(np.int64)), pa.array(id_), pa.array(rows[lo + doc]), pa.array((p - w.first[doc]).astype(np.int32)), pa.array(span.astype(np.int32)), pa.array(settled)], ["print", "key", "id", "row", "at", "span", "settled"])

    return docs.mapInArrow(run, "print long, key long, id long, row long, at int, span int, settled boolean")


TREE_ROW = "key long, id long, row long, at int, span int, around binary"
TREE_COLUMNS = ("key", "id", "row", "at", "span", "around")


def _around(docs: DataFrame, window: int, prefix: int, depth: int) -> DataFrame:
    """TREE_ROW of each suffix in column ``places``; around: fingerprints of the window - prefix words before it and of the depth words from it on."""
    left = window - prefix

    def run(batches):
        for batch in batches:
            ids, rows = (batch.column(n).to_numpy() for n in ("id", "row"))
            for lo, hi, data, off in slices(batch.column("text")):
                w = Words(data, off)
                p, doc, key, begin, end, _, _ = _marked(w, window, prefix, batch.column("places").slice(lo, hi - lo))
                spot = p[:, None] + np.arange(-left, depth)
                inside = (spot >= w.first[doc][:, None]) & (spot < w.first[doc + 1][:, None])
                around = np.where(inside, np.append(w.hashes(), U64(0))[np.where(inside, spot, 0)], U64(0))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[lo + doc]), pa.array(rows[lo + doc]), pa.array((p - w.first[doc]).astype(np.int32)), pa.array((64 * (p - end) + p - begin).astype(np.int32)), _bytes(around)], ["key", "id", "row", "at", "span", "around"])

    return docs.mapInArrow(run, TREE_ROW)


class Subtree:
    """The part of the suffix tree below some prefixes: suffixes in order, and how many words neighbours share."""

    def __init__(self, key: np.ndarray, around: np.ndarray, left: int):
        self.order = np.lexsort((*around[:, :left - 1:-1].T, key))
        before, after, key = around[self.order, :left], around[self.order, left:], key[self.order]
        same = after[1:] == after[:-1]
        same[:, 0] &= key[1:] == key[:-1]
        same &= after[1:] > 0  # beyond a text's end nothing is shared
        self.shared = np.append(0, np.cumprod(same, 1).sum(1)) if len(key) else np.zeros(0, np.int64)
        # Fingerprints of the 0, 1, .. words before each suffix.
        self.before = [np.zeros(len(key), U64)]
        for l in range(left):
            self.before.append(mix(self.before[-1] * _R + before[:, left - 1 - l] + U64(1)))
        self.begun = np.concatenate([np.zeros((len(key), 1), bool), before[:, ::-1] > 0], 1) if len(key) else np.zeros((0, left + 1), bool)

    def nodes(self, depth: int) -> np.ndarray:
        """The node of that depth (or leaf) that each suffix lies below, in order."""
        return np.cumsum(self.shared < depth)

    def lost(self, id_: np.ndarray, span: np.ndarray, window: int) -> np.ndarray:
        """For each suffix as given, a bit l for each window, l words before it, that a smaller document has."""
        id_, few, many = id_[self.order], span[self.order] // 64, span[self.order] % 64
        out = np.zeros(len(id_), np.int64)
        for l in range(len(self.before)):
            node, at = self.nodes(window - l), np.flatnonzero((few <= l) & (l <= many))
            at = at[np.bincount(node[at], minlength=len(node) + 1)[node[at]] > 1]
            group, own = mix(node[at].astype(U64) * _Q + self.before[l][at]), id_[at]
            order = np.lexsort((own, group))
            fresh = np.append(len(order) > 0, group[order[1:]] != group[order[:-1]])[: len(order)]
            least = own[order[fresh]][np.cumsum(fresh) - 1]
            gone = at[order[own[order] > least]]
            out[gone] |= 1 << l
        back = np.empty_like(out)
        back[self.order] = out
        return back

    def repeats(self, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words, words before the suffix, rows of the node) of deep internal nodes, as long as their suffixes agree on both sides."""
        depth = int(self.shared.max()) if len(self.shared) else 0
        for d in range(1, depth + 1):
            node = self.nodes(d)
            edge = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            size = np.diff(np.append(edge, len(node)))
            # Internal at this very depth: several suffixes that part right below it.
            least = np.minimum.reduceat(np.where(np.append(True, node[1:] != node[:-1]), depth + 1, self.shared), edge)
            for a, n in zip(edge[(size > 1) & (least == d)].tolist(), size[(size > 1) & (least == d)].tolist()):
                l = 0
                while l + 1 < len(self.before) and self.begun[a : a + n, l + 1].all() and (self.before[l + 1][a : a + n] == self.before[l + 1][a]).all():
                    l += 1
                if d + l >= window:
                    yield d + l, l, self.order[a : a + n]


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Sorted rows in tables of about ``rows`` rows (a group at least), cut between keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            all_ = pa.Table.from_batches(held)
            key = all_.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield all_.slice(0, cut)
            held = all_.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _subtrees(batches, rows: int, left: int) -> Iterator[tuple[pa.Table, Subtree]]:
    for group in _whole_groups(batches, rows):
        group = group.combine_chunks()
        raw = group.column("around").combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        n = len(group)
        ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + n + 1]
        around = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(U64).reshape(n, -1) if n else np.zeros((0, left + 1), U64)
        yield group, Subtree(group.column("key").to_numpy(), around, left)


def _judged(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds ``gone``: does a smaller document have the same keys? Rows stream in order, none is held."""

    def run(batches):
        least, was = None, None
        for batch in batches:
            if not len(batch):
                continue
            cols = np.stack([batch.column(k).to_numpy() for k in keys])
            id_ = batch.column("id").to_numpy()
            head = np.append(was is None or (cols[:, 0] != was).any(), (cols[:, 1:] != cols[:, :-1]).any(0))
            first = id_[head] if head[0] else np.concatenate([np.array([least], np.int64), id_[head]])
            first = first[np.cumsum(head) - bool(head[0])]
            least, was = first[-1], cols[:, -1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(id_ > first)], [*batch.schema.names, "gone"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", gone boolean")


def _by_windows(rows: DataFrame, window: int, prefix: int) -> DataFrame:
    """(row, at, lost) of suffixes below frequent prefixes: their windows one by one, by salt first."""
    left = window - prefix

    def run(batches):
        for batch in batches:
            around = np.frombuffer(b"".join(batch.column("around").to_pylist()), U64).reshape(len(batch), -1)
            few, many = np.divmod(batch.column("span").to_numpy(), 64)
            for l in range(left + 1):
                at = np.flatnonzero((few <= l) & (l <= many))
                key = np.zeros(len(at), U64)
                for c in range(left - l, left - l + window):
                    key = key * _R + around[at, c]
                own = batch.select(["id", "row", "at"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(mix(key).view(np.int64)), *own.columns, pa.array(np.full(len(at), 1 << l, np.int32))], ["key", "id", "row", "at", "lost"])

    salts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    open_ = rows.select("id", "row", "at", "span", "around").mapInArrow(run, "key long, id long, row long, at int, lost int")
    once = materialize(_judged(open_.withColumn("salt", F.pmod("row", F.lit(salts))), "key", "salt").drop("salt"), "salted")
    twice = _judged(once.where("not gone").drop("gone"), "key")
    return once.where("gone").unionByName(twice.where("gone")).select("row", "at", "lost")


def _at_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(id, row, text, places) of the documents with places (row, at)."""
    listed = places.groupBy("row").agg(F.collect_set("at").alias("places")).withColumnRenamed("row", "of").hint("shuffle_hash")
    return docs.join(listed, F.col("row") == F.col("of")).select("id", "row", "text", "places")


def lost_windows(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, depth: int = DEPTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """docs: (id, row, text), ids not null. (row, at, lost): bit l of lost says that the window l words before word ``at`` goes."""
    left = window - prefix
    depth = max(depth, window)
    leaves = _leaves(_at_places(docs, _shared(_suffixes(docs, window, prefix))), window, prefix)
    leaves = materialize(_judged(leaves, "print"), "leaves", "zstd")
    out = leaves.where("gone or settled").select("row", "at", F.expr("(shiftleft(2, cast(span % 64 as int)) - shiftleft(1, cast(span div 64 as int)))").cast("int").alias("lost"))

    # Below a prefix with one leaf left there is no node.
    open_ = leaves.where("not gone and not settled")
    keys = open_.groupBy("key").agg(F.count("*").alias("n"), F.min("print").alias("a"), F.max("print").alias("b")).where("a <> b")
    open_ = materialize(open_.join(keys.select(F.col("key").alias("of"), "n"), F.col("key") == F.col("of")).select("row", "at", (F.col("n") > group_rows).alias("frequent")), "open")
    frequent = open_.where("frequent").limit(1).count() > 0

    def run(batches):
        for group, tree in _subtrees(batches, group_rows, left):
            lost = tree.lost(group.column("id").to_numpy(), group.column("span").to_numpy(), window)
            own = group.select(["row", "at"]).append_column("lost", pa.array(lost.astype(np.int32))).filter(pa.array(lost > 0))
            yield from own.to_batches()

    rows = _around(_at_places(docs, open_.where("not frequent")), window, prefix, depth)
    out = out.unionByName(rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "row long, at int, lost int"))
    if frequent:
        out = out.unionByName(_by_windows(_around(_at_places(docs, open_.where("frequent")), window, prefix, depth), window, prefix))
    return out


def _frequent_nodes(rows: DataFrame, depth: int, left: int, window: int, last: bool) -> DataFrame:
    """repeats() of nodes at the depth of their prefix, whose suffixes (all under one key) are too many for one tree: found by aggregation.

    last: nothing is known beyond this depth, so suffixes need not part here.
    """
    word = lambda at, n=1: F.substring("around", 8 * at + 1, 8 * n)
    sides = [f(word(left - l, l)).alias(f"{name}{l}") for l in range(1, left + 1) for name, f in (("a", F.min), ("b", F.max))]
    more = [] if last else [F.min(word(left + depth)).alias("low"), F.max(word(left + depth)).alias("high")]
    g = rows.groupBy("key").agg(F.count("*").alias("suffixes"), F.min(F.struct("id", "at")).alias("first"), *more, *sides)
    # The words before that all suffixes share: sharing more of them implies sharing fewer.
    same = sum(((F.col(f"a{l}") == F.col(f"b{l}")) & (F.substring(f"a{l}", 1, 8) != F.lit(bytes(8)))).cast("int") for l in range(1, left + 1))
    # Suffixes part where their next words differ, and where texts end, each by itself.
    internal = (F.col("suffixes") > 1) & (F.lit(True) if last else (F.col("low") != F.col("high")) | (F.col("low") == F.lit(bytes(8))))
    out = g.where(internal).withColumn("l", same).where(F.col("l") + depth >= window)
    return out.select((F.col("l") + depth).cast("long").alias("words"), "suffixes", F.col("first.id").alias("id"), (F.col("first.at") - F.col("l")).cast("long").alias("at"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, depth: int = DEPTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Maximal repeats of at least ``window`` words, read from deep internal nodes: ``words``, ``suffixes`` below, and the least id with the word it starts at.

    A node knows window - PREFIX words before its suffixes and ``depth`` from them on; a longer repeat shows as the nodes of its
    several suffixes, which overlap. A prefix of more than ``group_rows`` suffixes has its own node found by aggregation and is extended by a
    word, and again, until what is left below it fits memory.
    """
    left, depth = window - PREFIX, max(depth, window)
    rows = _identified(docs, id_col, text_col).where("id is not null")
    rows = materialize(_around(_at_places(rows, _shared(_suffixes(rows, window, PREFIX))), window, PREFIX, depth), "suffixes", "zstd")

    def run(batches):
        for group, tree in _subtrees(batches, group_rows, left):
            ids, ats = group.column("id").to_numpy(), group.column("at").to_numpy()
            out = []
            for n, l, at in tree.repeats(window):
                k = at[np.lexsort((ats[at], ids[at]))[0]]
                out.append((n, len(at), ids[k], ats[k] - l))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["words", "suffixes", "id", "at"])

    found, known = None, PREFIX
    while True:
        sizes = rows.groupBy(F.col("key").alias("of")).agg((F.count("*") > group_rows).alias("frequent"))
        rows = rows.join(sizes, F.col("key") == F.col("of"))
        small, large = rows.where("not frequent").select(*TREE_COLUMNS), rows.where("frequent").select(*TREE_COLUMNS)
        here = small.repartition("key").sortWithinPartitions("key").mapInArrow(run, "words long, suffixes long, id long, at long")
        found = here if found is None else found.unionByName(here)
        if large.isEmpty():
            return found
        found = found.unionByName(_frequent_nodes(large, known, left, window, known == depth))
        if known == depth:
            return found
        following = F.substring("around", 8 * (left + known) + 1, 8)
        rows = materialize(large.where(following != F.lit(bytes(8))).withColumn("key", F.xxhash64("key", following)), "extended", "zstd")
        known += 1


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("id", F.xxhash64("id", "text").alias("row"), "text")


def _covered(w: Words, windows: pa.Array, window: int) -> np.ndarray:
    """Words in one of the windows (at, lost) of their document."""
    count, flat = _lists(windows)
    base = np.repeat(w.first[:-1], count)
    cover = np.zeros(len(w.start) + 1, np.int64)
    if len(flat):
        at, lost = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("at", "lost"))
        for l in range(int(lost.max()).bit_length()):
            start = (base + at - l)[lost >> l & 1 > 0]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + window, -1)
    return np.cumsum(cover[:-1]) > 0


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, depth: int = DEPTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed`` and ``kept``, the kept words joined by one space."""
    rows = _identified(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in slices(batch.column("text")):
                w = Words(data, off)
                gone = _covered(w, batch.column("windows").slice(lo, hi - lo), window)
                removed = np.add.reduceat(np.append(gone, False), np.minimum(w.first[:-1], len(gone))) * (w.per_doc > 0)
                keep = ~gone
                size = (w.end - w.start + 1)[keep]  # with the space that follows
                from_, to = w.start[keep], np.cumsum(size)
                out = np.full(int(size.sum()), 32, np.uint8)
                spot = np.repeat(to - size, size - 1) + _ramp(size - 1)
                out[spot] = w.data[np.repeat(from_, size - 1) + _ramp(size - 1)]
                ends = np.concatenate([[0], np.cumsum(np.bincount(w.doc[keep], size, w.docs).astype(np.int64))])
                texts = [out[a : max(a, b - 1)].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), long(w.per_doc), long(removed), pa.array(texts, pa.binary()).cast(pa.string())], [id_col, "n_words", "n_removed", "kept"])

    known = rows.where("id is not null")
    lost = lost_windows(known, window, depth=depth, group_rows=group_rows).groupBy("row").agg(F.collect_set(F.struct("at", "lost")).alias("windows")).withColumnRenamed("row", "of").hint("shuffle_hash")
    found = known.join(lost, F.col("row") == F.col("of"), "left").select("id", "text", "windows")
    found = found.unionByName(rows.where("id is null").select("id", "text", F.lit(None).cast(found.schema["windows"].dataType).alias("windows")))
    return found.mapInArrow(run, f"`{id_col}` long, n_words long, n_removed long, kept string")


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for every size in turn."""
    total = np.cumsum(sizes)
    return np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - sizes, sizes)


def digest(kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return kept.select(id_col, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


__all__ = ["Subtree", "anchors", "digest", "lost_windows", "repeats", "report"]
