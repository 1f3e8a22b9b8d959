"""Exact top-k inner products by no-random-access aggregation (NRA).

Vectors become integers floor(scale * x). Candidates are dealt into blocks of a fixed number of
vectors; a block keeps one list of its vectors for every dimension, sorted by component. A query
reads all lists of a block in step, from the end that its sign favours, and never looks a vector up. What has been read
gives each candidate a lower and an upper score bound (an unread component lies between the list's far end and
the value last read). Outsiders, whose upper bound is below the k-th lower bound, are skipped in all reads to come;
reading stops when every component of the candidates left has come by, which is when their scores are final.
The best k of every block meet in an aggregation by query, which needs k rows a block and query at most.

Queries (a stated subset) also form blocks, so one task holds one block of each kind.

Defined cases: vectors that are null, or hold null or non-finite components, or have no id, take no part; a shorter vector counts as
padded with zeros; ties go to the smaller id; with fewer than k candidates all are returned; a repeated id is two candidates and, if it
asks, two queries with a list each, and a query skips every candidate with its own id; all sums are 64-bit integers, and vectors so
large that a score could exceed them raise a ValueError.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BLOCK, QUERY_BLOCK, FIRST_DEPTH = 8192, 1024, 256
#: For each byte, which of its bits are not set.
_UNSET = 1 - (np.arange(256)[:, None] >> np.arange(8) & 1)


class SortedLists:
    """One block's candidates: for each dimension the candidates by falling component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, small: bool = False):
        """small: no sum of products reaches 2^53, so that doubles hold them exactly."""
        self.small = small
        order = np.argsort(ids, kind="stable")
        self.ids, x = ids[order], x[order]
        self.order = np.argsort(-x, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(x, self.order.T, 0).T.copy()

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best candidates but the query's own, best first."""
        dims, n = self.order.shape
        up = query >= 0
        worst = np.where(up, self.sorted[:, -1], self.sorted[:, 0]) * query
        live = self.ids != own
        k = min(k, int(live.sum()))
        if not k:
            return self.ids[:0], self.ids[:0]
        score = np.zeros(n, np.int64)
        groups = -(-dims // 8)
        seen = np.zeros((groups, n), np.uint8)
        bit = 2.0 ** (np.arange(dims) % 8)
        depth, step, finalists = 0, FIRST_DEPTH, np.flatnonzero(live)
        while True:
            upto = min(n, depth + step)
            ids, value = self._read(self.order, up, depth, upto), self._read(self.sorted, up, depth, upto) * query[:, None]
            last, width = value[:, -1], upto - depth
            at = np.flatnonzero(live[ids])
            ids, value, group = ids.ravel()[at], value.ravel()[at], at // width
            self._add(score, ids, value)
            edges = np.searchsorted(group, np.arange(0, dims + 8, 8))
            for g in range(groups):
                part = slice(edges[g], edges[g + 1])
                seen[g] += np.bincount(ids[part], bit[group[part]], n).astype(np.uint8)
            depth, step = upto, depth + step
            if depth == n:
                break
            lower = score[finalists] + self._unread(seen[:, finalists], worst)
            upper = score[finalists] + self._unread(seen[:, finalists], last)
            at_least = np.partition(lower, len(lower) - k)[len(lower) - k]
            stay = upper >= at_least  # an equal bound could still win a tie
            live[finalists[~stay]] = False
            if (lower[stay] == upper[stay]).all() and self._whole(seen[:, finalists[stay]], dims):
                finalists = finalists[stay]
                break
            finalists = finalists[stay]
        pick = finalists[np.lexsort((self.ids[finalists], -score[finalists]))[:k]]
        return self.ids[pick], score[pick]

    def _add(self, score: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        if self.small:
            score += np.bincount(ids, value, len(score)).astype(np.int64)
        else:
            np.add.at(score, ids, value)

    @staticmethod
    def _whole(seen: np.ndarray, dims: int) -> bool:
        """Have all components of all of them been read?"""
        return all((part == (1 << min(8, dims - 8 * g)) - 1).all() for g, part in enumerate(seen))

    @staticmethod
    def _read(lists: np.ndarray, up: np.ndarray, depth: int, upto: int) -> np.ndarray:
        """Entries depth to upto of every list, from its front or its back."""
        n = lists.shape[1]
        return np.where(up[:, None], lists[:, depth:upto], lists[:, n - upto : n - depth][:, ::-1])

    @staticmethod
    def _unread(seen: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Sum of value over the lists in which a candidate has not been read."""
        out = np.zeros(seen.shape[1], np.int64)
        for g in range(len(seen)):
            part = value[8 * g : 8 * g + 8]
            out += (_UNSET[:, : len(part)] @ part)[seen[g]]
        return out


def _vectors(lists: pd.Series, dims: int) -> np.ndarray:
    """Rows of components, short ones padded with zeros."""
    out = np.zeros((len(lists), dims), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def search(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k largest integer inner products of every query."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).where(fine)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("x"), F.array_max(F.transform(x, lambda v: F.abs(v * scale))).alias("most"))
    # Counts only: how many blocks of each kind to deal rows into, and how large a score can get.
    asks = is_query(F.col("id"))
    total = rows.agg(F.max(F.size("x")).alias("dims"), F.count("*").alias("n"), F.sum(asks.cast("long")).alias("queries"), F.max("most").alias("most"), F.max(F.when(asks, F.col("most"))).alias("most_asked")).first()
    dims, n, n_queries = total["dims"] or 0, total["n"], total["queries"] or 0
    bound = dims * ((total["most"] or 0.0) + 1) * ((total["most_asked"] or 0.0) + 1)
    if bound >= 2.0**62:
        raise ValueError("scores could exceed a long integer: scale the vectors down")
    dims = max(1, dims)
    n_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    blocks = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.select("id", "x").withColumn("block", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(n_blocks)).cast("int")).withColumn("q_block", blocks(q_blocks))
    # Rows that share an id are numbered by their vectors, so that each has a list of its own.
    queries = rows.where(asks).select("id", "x", F.row_number().over(W.partitionBy("id").orderBy("x")).alias("nth"))
    queries = queries.withColumn("q_block", F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(q_blocks)).cast("int")).withColumn("block", blocks(n_blocks))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            lists = SortedLists(right["id"].to_numpy(), _vectors(right["x"], dims), bound < 2.0**53)
            for q, nth, x in zip(left["id"].tolist(), left["nth"].tolist(), _vectors(left["x"], dims)):
                ids, scores = lists.top(x, q, k)
                out += [(q, nth, i, s) for i, s in zip(ids.tolist(), scores.tolist())]
        return pd.DataFrame(out, columns=["query_id", "nth", "vec_id", "score"]).astype("int64")

    found = queries.groupBy("q_block", "block").cogroup(candidates.groupBy("q_block", "block")).applyInPandas(run, "query_id long, nth long, vec_id long, score long")
    best = W.partitionBy("query_id", "nth").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
