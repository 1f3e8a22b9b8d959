"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in partitions as they were read. How many rows each partition sends to each block of a shard is drawn from the law that
a uniform permutation would give: a multivariate hypergeometric one, whose row sums are the partitions' sizes and whose column sums are
the blocks'. No task needs the whole matrix: partitions form a binary tree, and at each node the room of all blocks is dealt between
its halves by a generator seeded with the node, so a task draws its own row by walking down to its partition.
Within its partition a task deals the row's counts to its rows in random order, chunk by chunk. After the exchange every block is permuted
again. Block sizes are known beforehand, so slots need no further counting, and no task holds more than one block.

A shard of any size is cut into blocks of at most ``block_rows`` rows; sizes of shards differ by one row at most. Keys and texts play no part, so
no group of equal rows can make a task large.

Rows are written once, with their partition and place, before counts are taken; what is drawn is a function of those two numbers and the seed, so a
task run again deals its rows as before. Other partitions of the same rows (another layout of the files) give another shuffle.

Defined cases: nulls in any column are kept; equal and repeated rows are separate rows; an empty table gives no rows; with fewer rows than shards the last
shards are empty; columns of the table named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from marketlab.llm._store import materialize

SHARDS, BLOCK_ROWS, CHUNK, SEED = 24, 65536, 16384, 29
#: Totals that NumPy's generators take.
_MOST = 10**9
_IN_PART = (1 << 33) - 1


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn without return are good."""
    if good + bad < _MOST:
        return int(rng.hypergeometric(good, bad, n)) if n and good else 0
    low, high = max(0, n - bad), min(n, good)
    total = good + bad
    spread = np.sqrt(n * (good / total) * (bad / total) * max(0.0, (total - n) / (total - 1)))
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    # Weights relative to the mode; beyond 12 deviations they are below 1e-30.
    first, last = max(low, mode - int(12 * spread) - 20), min(high, mode + int(12 * spread) + 20)
    x = np.arange(first, last, dtype=float)
    steps = np.log((good - x) * (n - x)) - np.log((x + 1) * (bad - n + x + 1))
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    up_to = np.cumsum(np.exp(weight - weight.max()))
    return first + int(np.searchsorted(up_to, rng.random() * up_to[-1], "right"))


def deal(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """n rows drawn without return from places of several kinds: how many of each."""
    total = int(room.sum())
    if total < _MOST:
        return rng.multivariate_hypergeometric(room, n, method="marginals") if n else np.zeros_like(room)
    if len(room) == 1:
        return np.array([n], room.dtype)
    half = len(room) // 2
    left = hypergeometric(rng, int(room[:half].sum()), int(room[half:].sum()), n)
    return np.concatenate([deal(rng, room[:half], left), deal(rng, room[half:], n - left)])


class Matrix:
    """The communication matrix of partitions and blocks, of which any row can be drawn alone."""

    def __init__(self, sizes: np.ndarray, room: np.ndarray, seed: int = SEED):
        self.sizes, self.room, self.seed = sizes, room, seed
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self._nodes: dict[tuple[int, int], np.ndarray] = {}

    def _left(self, lo: int, mid: int, hi: int, room: np.ndarray) -> np.ndarray:
        """What the left half of a node takes; the nodes near the root are kept, since all partitions ask for them."""
        found = self._nodes.get((lo, hi))
        if found is None:
            found = deal(np.random.default_rng([self.seed, 0, lo, hi]), room, int(self.ends[mid] - self.ends[lo]))
            if 64 * (hi - lo) >= len(self.sizes) and len(self._nodes) < 128:
                self._nodes[lo, hi] = found
        return found

    def row(self, part: int) -> np.ndarray:
        """How many rows the partition sends to each block."""
        lo, hi, room = 0, len(self.sizes), self.room
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = self._left(lo, mid, hi, room)
            lo, hi, room = (lo, mid, left) if part < mid else (mid, hi, room - left)
        return room

    def labels(self, part: int) -> Iterator[np.ndarray]:
        """The blocks of the partition's rows, chunk by chunk, in random order."""
        row = self.row(part)
        blocks = np.flatnonzero(row)
        room, rng = row[blocks], np.random.default_rng([self.seed, 1, part])
        while left := int(room.sum()):
            take = deal(rng, room, min(CHUNK, left))
            room = room - take
            yield rng.permutation(np.repeat(blocks, take))


def _block_sizes(rows: int, shards: int, block_rows: int) -> tuple[int, np.ndarray]:
    """(blocks in each shard, rows of every block, shard by shard)."""
    each = max(1, -(-(-(-rows // shards)) // block_rows))
    shard = rows // shards + (np.arange(shards) < rows % shards)
    return each, (shard[:, None] // each + (np.arange(each) < shard[:, None] % each)).ravel()


def shuffle(table: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The table's rows with ``shard`` (from 0) and ``slot`` (from 0 without gaps in each shard)."""
    own = [c for c in table.columns if c.lower() not in ("shard", "slot")]
    row = F.struct(*(F.col(f"`{c}`") for c in own)).alias("row")
    rows = materialize(table.select(row, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PART)).alias("at")), "rows")
    counted = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a number a partition
    sizes = np.array([counted.get(p, 0) for p in range(max(counted, default=-1) + 1)], np.int64)
    n = int(sizes.sum())
    each, room = _block_sizes(n, shards, block_rows)
    matrix = Matrix(sizes, room, seed)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, source, now = None, -1, iter(()), np.zeros(0, np.int64)
        for batch in batches:
            parts, ats = batch.column("part").to_numpy(), batch.column("at").to_numpy()
            out = np.empty(len(parts), np.int64)
            edges = np.flatnonzero(np.diff(parts, prepend=-1) | np.diff(ats // CHUNK, prepend=-1))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(parts)]):
                p, c = int(parts[lo]), int(ats[lo]) // CHUNK
                if p != part or c < chunk:
                    part, chunk, source = p, -1, matrix.labels(p)
                while chunk < c:
                    now, chunk = next(source), chunk + 1
                out[lo:hi] = now[ats[lo:hi] % CHUNK]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "block"])

    dealt = rows.mapInArrow(label, T.StructType([*rows.schema.fields, T.StructField("block", T.LongType())]))
    # The second permutation: by a hash of the row's first place, which is no column of the data.
    again = W.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "part", "at"), "part", "at")
    shard, j = F.floor(F.col("block") / each), F.col("block") % each
    in_shard = F.lit(n // shards) + (shard < n % shards).cast("long")
    size, more = F.floor(in_shard / each), in_shard % each
    slot = j * size + F.least(j, more) + F.row_number().over(again) - 1
    return dealt.select("row", shard.cast("int").alias("shard"), slot.cast("long").alias("slot")).select("row.*", "shard", "slot")


def write_shards(placed: DataFrame, path: str) -> None:
    """Parquet files below one folder a shard; each file holds whole blocks of its shard in the order of slots."""
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
