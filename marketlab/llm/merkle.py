"""A Merkle manifest of a table, with a witness for every row, built by appending.

Rows are hashed to leaves, ordered inside their group and dealt into aligned blocks of ARITY^DEPTH consecutive leaves. A block's leaves are
appended one after another: every open subtree carries the partial witnesses of the leaves below it, and when its run of siblings is
complete, each of those witnesses grows by the siblings that came before and after. A block's root is then appended, in the same way, to the
tree of block roots, so that the witness of a leaf is the one inside its block, extended by its block's; the groups' roots are appended to the top tree.

Blocks are told apart by Spark and hold a fixed number of leaves, so neither a large group nor a long table makes a task large; each
round leaves one node of 4096, so two or three rounds end any table. Nothing but the number of rounds is seen by the driver.

A witness is ``siblings`` (hex digests, level by level, left to right) and ``places`` (two digits a level: the node's place in its run, and the run's length).

Defined cases: a null value hashes as '-', so it differs from every text; a null group is a group of its own, before all others; leaves of a group
ascend by id, null first, and rows with one id by digest; equal rows are leaves of their own with witnesses of their own; a lone leaf is its group's root and has
no siblings there; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from binascii import hexlify
from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marketlab.llm._store import materialize

ARITY, DEPTH = 8, 4
_IN_PART = (1 << 33) - 1


def leaf(*values: Column) -> Column:
    """Hex digest of values, each '-' if null, else its UTF-8 length, a colon and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def _h(parts: list[bytes]) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def levels_of(n: int) -> int:
    """How often n nodes must be grouped until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Appender:
    """A tree of a fixed number of levels that leaves (hex digests) are appended to.

    open: for each level the run that is not complete yet, as (digest, first leaf, leaf after the last) of its subtrees.
    """

    def __init__(self, levels: int, witnesses: bool = True):
        self.levels, self.witnesses, self.count, self.root = levels, witnesses, 0, b""
        self.open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(levels)]
        self.siblings: list[bytearray] = []
        self.places: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        if self.witnesses:
            self.siblings.append(bytearray())
            self.places.append(bytearray())
        self.count += 1
        self._add(0, digest, self.count - 1, self.count)

    def _add(self, level: int, digest: bytes, first: int, last: int) -> None:
        if level == self.levels:
            self.root = digest
            return
        self.open[level].append((digest, first, last))
        if len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """The run's subtrees are siblings now: their leaves' witnesses grow, and they become one subtree of the next level."""
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        if self.witnesses:
            for place, (_, first, last) in enumerate(run):
                self.extend(first, last, b"".join(digests[:place] + digests[place + 1 :]), b"%d%d" % (place, len(run)))
        self._add(level + 1, _h(digests), run[0][1], run[-1][2])

    def extend(self, first: int, last: int, siblings: bytes, places: bytes) -> None:
        for i in range(first, last):
            self.siblings[i] += siblings
            self.places[i] += places

    def close(self) -> Appender:
        """No more leaves will come: runs that are not full are complete as they are."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self


def _filled(digests: pa.Array, n: int, depth: int, witnesses: bool) -> Appender:
    """The block of these leaves; n: the nodes of its group, which say how high the block is."""
    tree = Appender(min(depth, levels_of(n)), witnesses)
    text = hexlify(b"".join(digests.to_pylist()))
    for i in range(0, len(text), 64):
        tree.append(text[i : i + 64])
    return tree.close()


def _roots(depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            one = batch.slice(i, 1)
            tree = _filled(one.column("nodes").flatten().field("digest"), one.column("n")[0].as_py(), depth, False)
            yield pa.RecordBatch.from_arrays([*one.columns, pa.array([bytes.fromhex(tree.root.decode())], pa.binary())], names=[*one.schema.names, "root"])


def _spread(depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a node: its block's witnesses, extended by the block's own."""
    for batch in batches:
        for i in range(len(batch)):
            one = batch.slice(i, 1)
            nodes = one.column("nodes").flatten()
            tree = _filled(nodes.field("digest"), one.column("n")[0].as_py(), depth, True)
            tree.extend(0, tree.count, one.column("upper_siblings")[0].as_py().encode(), one.column("upper_places")[0].as_py().encode())
            again = lambda name: pa.array([one.column(name)[0].as_py()] * tree.count, pa.string())
            yield pa.record_batch({
                "grp": again("grp"), "pos": nodes.field("pos"), "digest": nodes.field("digest"), "more": nodes.field("more"), "top": again("top"), "root": again("whole"),
                "siblings": pa.array([s.decode() for s in tree.siblings], pa.string()), "places": pa.array([p.decode() for p in tree.places], pa.string()),
            })


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place in the group by ``order``, and ``n``, the group's rows; rows: has grp and digest.

    Equal rows are told apart by a random number, so that no partition must hold all of them.
    """
    by = ["grp", *order, "_salt"]
    spread = rows.withColumn("_salt", F.rand(11)).repartitionByRange(*by).sortWithinPartitions(*by).drop("_salt")
    sorted_ = materialize(spread.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PART))}), "sorted", "zstd")
    # A row a partition and group that meet.
    runs = sorted_.groupBy("grp", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    group = W.partitionBy("grp")
    runs = runs.select("grp", "part", "first", (F.sum("rows").over(group.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("rows")).alias("before"), F.sum("rows").over(group).alias("n"))
    return sorted_.join(runs, ["grp", "part"]).select("*", (F.col("before") + F.col("at") - F.col("first")).alias("pos")).drop("part", "at", "first", "before")


def _blocks(nodes: DataFrame, depth: int) -> DataFrame:
    """A row a block: its nodes in order, and its root."""
    packed = nodes.groupBy("grp", F.floor(F.col("pos") / ARITY**depth).alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "digest", "more"))).alias("nodes"))
    kind = nodes.select(F.struct("pos", "digest", "more")).schema[0].dataType.simpleString()
    return materialize(packed.mapInArrow(partial(_roots, depth), f"grp string, block long, n long, nodes array<{kind}>, root binary"), "blocks", "zstd")


def _upper(blocks: DataFrame, depth: int) -> DataFrame:
    """grp, block, and the ``top`` of the group's tree with the block root's witness in it, once all block roots are appended."""
    roots = blocks.select("grp", F.col("block").alias("pos"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("more"), F.ceil(F.col("n") / ARITY**depth).alias("n"))
    if blocks.where("block > 0").isEmpty():
        return roots.select("grp", F.col("pos").alias("block"), F.lower(F.hex("digest")).alias("top"), F.lit("").alias("upper_siblings"), F.lit("").alias("upper_places"))
    above = _blocks(roots, depth)
    found = _witnessed(above, _upper(above, depth).withColumn("whole", F.col("top")), depth)
    return materialize(found.select("grp", F.col("pos").alias("block"), "top", F.col("siblings").alias("upper_siblings"), F.col("places").alias("upper_places")), "upper", "zstd")


def _witnessed(blocks: DataFrame, upper: DataFrame, depth: int) -> DataFrame:
    """A row a node of the blocks, with the whole witness; upper: has grp, block, top, whole, upper_siblings and upper_places."""
    kind = blocks.schema["nodes"].dataType.elementType["more"].dataType.simpleString()
    return blocks.drop("root").join(upper, ["grp", "block"]).mapInArrow(partial(_spread, depth), f"grp string, pos long, digest binary, more {kind}, top string, root string, siblings string, places string")


def witnesses(leaves: DataFrame, more: list[str] = (), depth: int = DEPTH) -> DataFrame:
    """leaf, subroot, root, siblings and places of every leaf, and the columns ``more`` as they were.

    leaves: ``group`` (string), ``id``, ``leaf`` (hex digest) and the columns ``more``, which must have an order.
    """
    # '-' sorts before '=', so the null group comes first and no text equals it.
    grp = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit("-")).alias("grp")
    carried = F.struct(F.col("id"), *(F.col(c) for c in more)).alias("more")
    slim = materialize(leaves.select(grp, F.unhex("leaf").alias("digest"), carried), "leaves", "zstd")
    blocks = _blocks(_placed(slim, ["more.id", "digest"]), depth)
    upper = _upper(blocks, depth)
    # The groups' roots are appended to the top tree like any others.
    tops = upper.where("block = 0").select(F.lit("=").alias("grp"), F.unhex("top").alias("digest"), F.col("grp").alias("more"))
    top_blocks = _blocks(_placed(tops, ["more"]), depth)
    groups = _witnessed(top_blocks, _upper(top_blocks, depth).withColumn("whole", F.col("top")), depth).select(F.col("more").alias("grp"), F.col("top").alias("whole"), F.col("siblings").alias("s"), F.col("places").alias("p"))
    full = upper.join(materialize(groups, "groups"), "grp").select("grp", "block", "top", "whole", F.concat("upper_siblings", "s").alias("upper_siblings"), F.concat("upper_places", "p").alias("upper_places"))
    out = _witnessed(blocks, full, depth)
    return out.select("more.*", F.lower(F.hex("digest")).alias("leaf"), F.col("top").alias("subroot"), "root", "siblings", "places")


def _fold_one(digest: str, siblings: str, places: str) -> str:
    at = 0
    for i in range(0, len(places), 2):
        place, size = int(places[i]), int(places[i + 1])
        left, right = siblings[at : at + 64 * place], siblings[at + 64 * place : at + 64 * (size - 1)]
        digest, at = sha256((left + digest + right).encode()).hexdigest(), at + 64 * (size - 1)
    return digest


def _fold(leaf: pd.Series, siblings: pd.Series, places: pd.Series) -> pd.Series:
    return pd.Series([_fold_one(*x) for x in zip(leaf, siblings, places)], dtype=object)


def fold(leaf: Column, siblings: Column | str = "siblings", places: Column | str = "places") -> Column:
    """The root that a leaf and a witness lead to."""
    return F.pandas_udf(_fold, "string")(leaf, siblings, places)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), also: dict[str, Column] | None = None) -> DataFrame:
    """id, leaf, subroot, root, siblings and places of every row; also: further columns to carry along, which take no part in the tree."""
    own = leaf(*(F.col(f) for f in fields))
    leaves = docs.select(F.col(group_col).cast("string").alias("group"), F.col(id_col).alias("id"), own.alias("leaf"), *(c.alias(name) for name, c in (also or {}).items()))
    return witnesses(leaves, list(also or {})).withColumnRenamed("id", id_col)
