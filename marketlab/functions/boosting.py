"""Boosted trees of depth two: fitted in NumPy inside a task on the bins of its examples, equal ones as one, and their score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A tree: feature and limit of the root and of its two children, and the four leaves' values from left to right.
TREE = "struct<f:int,t:double,lf:int,lt:double,rf:int,rt:double,v:array<double>>"
ROUNDS, RATE, SHARE, BINS = 150, 0.05, 0.8, 32


def _best(codes: np.ndarray, g: np.ndarray, n: np.ndarray, edges: list[np.ndarray]) -> tuple[float, int, float]:
    """(gain, feature, limit) of the split that leaves the least squared error; g and n: sum and number of each cell's examples; no gain: everything goes left."""
    width, d = BINS + 1, codes.shape[1]
    sums, counts = (np.stack([np.bincount(codes[:, f], w, width) for f in range(d)]).cumsum(1) for w in (g, n))
    total, most = sums[:, -1:], counts[:, -1:]
    inside = (counts > 0) & (counts < most)
    gain = np.where(inside, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(most - counts, 1) - total**2 / np.maximum(most, 1), -1.0)
    f, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (float(gain[f, c]), int(f), float(edges[f][c])) if gain[f, c] > 1e-12 else (0.0, 0, np.inf)


def encode(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value, a byte each; edges: sorted limits of each feature, at most BINS - 1."""
    return np.stack([np.searchsorted(e, c, "left").astype(np.uint8) for e, c in zip(edges, x.T)], axis=1)


def cells(codes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows of codes, in order; number of examples in each with y = 0 and y = 1)."""
    key = np.zeros(len(codes), np.int64)
    for k, column in enumerate(codes.T):
        if k and k % 5 == 0:  # else the key outgrows its 64 bits
            key = np.unique(key, return_inverse=True)[1]
        key = key * (BINS + 1) + column
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    ones = np.bincount(at, y, len(first)).astype(np.int64)
    return codes[first], np.stack([np.bincount(at, minlength=len(first)) - ones, ones], axis=1)


def _drawn(rng: np.random.Generator, counts: np.ndarray, m: int) -> np.ndarray:
    """How many of m examples, drawn without putting back, come from each of the counts. Over 1e9 examples, which NumPy does not draw from, each is taken by itself."""
    if counts.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(counts, m, method="marginals")
    return rng.binomial(counts, SHARE)


def fit_cells(codes: np.ndarray, counts: np.ndarray, edges: list[np.ndarray], seed: int, rounds: int = ROUNDS) -> tuple[float, list[tuple], np.ndarray]:
    """(first score, trees, share of the gain by feature) for the chance that y is 1, from cells(): examples with the same bins move together, so only their number counts.

    Every round draws its share of the examples anew, by cell.
    """
    rng = np.random.default_rng(seed)
    limits = [np.concatenate([e, np.full(BINS + 1 - len(e), np.inf)]) for e in edges]
    whole, ones = int(counts.sum()), int(counts[:, 1].sum())
    base = float(np.log(ones / (whole - ones)))
    score, gains, trees, m = np.full(len(codes), base), np.zeros(codes.shape[1]), [], max(1, int(SHARE * whole))
    bin_of = lambda f, t: np.searchsorted(limits[f], t)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        drawn = _drawn(rng, counts.ravel(), m).reshape(-1, 2)
        n = drawn.sum(1)
        g, h = drawn[:, 1] - p * n, n * p * (1 - p)
        gain, f, t = _best(codes, g, n, limits)
        left = codes[:, f] <= bin_of(f, t)
        children = [_best(codes[side], g[side], n[side], limits) for side in (left, ~left)]
        (_, lf, lt), (_, rf, rt) = children
        leaf = np.where(left, np.where(codes[:, lf] <= bin_of(lf, lt), 0, 1), np.where(codes[:, rf] <= bin_of(rf, rt), 2, 3))
        values = np.bincount(leaf, g, 4) / np.maximum(np.bincount(leaf, h, 4), 1e-12)
        score = score + RATE * values[leaf]
        for own, feature in ((gain, f), *((c[0], c[1]) for c in children)):
            gains[feature] += own
        trees.append((f, t, lf, lt, rf, rt, values.tolist()))
    return base, trees, gains / max(gains.sum(), 1e-300)


def fit(x: np.ndarray, y: np.ndarray, seed: int, rounds: int = ROUNDS) -> tuple[float, list[tuple], np.ndarray]:
    """fit_cells() of one array of examples; x: a row an example."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    return fit_cells(*cells(encode(x, edges), y), edges, seed, rounds)


def probability(base: Column, trees: Column, x: Column) -> Column:
    """The chance that an example with features x is 1, from trees that lie in its row; for many rows, chance() is faster."""
    at = lambda i: F.get(x, i)

    def leaf(s: Column) -> Column:
        return F.when(at(s["f"]) <= s["t"], F.when(at(s["lf"]) <= s["lt"], s["v"][0]).otherwise(s["v"][1])).otherwise(F.when(at(s["rf"]) <= s["rt"], s["v"][2]).otherwise(s["v"][3]))

    return 1 / (1 + F.exp(-F.aggregate(trees, base, lambda total, s: total + RATE * leaf(s))))


def chance(spark: SparkSession, models: dict, key: list[Column], x: Column) -> Column:
    """The same from ``models``, known by the values of the key: (base, trees). Where there is none, it is null. The models go to every executor once."""
    packed = {k: (base, [np.array(c) for c in zip(*(t[:6] for t in trees))], np.array([t[6] for t in trees])) for k, (base, trees) in models.items()}
    shared = spark.sparkContext.broadcast(packed)

    def run(x: pa.Array, *key: pa.Array) -> pa.Array:
        coded = [k.dictionary_encode() for k in key]
        number = np.zeros(len(x), np.int64)
        for c in coded:
            number = number * (len(c.dictionary) + 1) + c.indices.fill_null(len(c.dictionary)).to_numpy(zero_copy_only=False)
        out, known = np.zeros(len(x)), np.zeros(len(x), bool)
        names = [c.dictionary.to_pylist() + [None] for c in coded]
        for n in np.unique(number):
            rows, name = np.flatnonzero(number == n), []
            for values in reversed(names):
                n, at = divmod(int(n), len(values))
                name.insert(0, values[at])
            if tuple(name) in shared.value:
                found = x.take(pa.array(rows))
                known[rows], out[rows] = True, scored(*shared.value[tuple(name)], found.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))
        return pa.array(out, mask=~known)

    return F.arrow_udf(run, "double")(x, *key)


def scored(base: float, splits: list[np.ndarray], values: np.ndarray, x: np.ndarray) -> np.ndarray:
    columns, score = np.ascontiguousarray(x.T), np.full(len(x), base)
    for f, t, lf, lt, rf, rt, v in zip(*splits, values):
        leaf = np.where(columns[f] <= t, columns[lf] > lt, 2 + (columns[rf] > rt))
        score += RATE * v[leaf]
    return 1 / (1 + np.exp(-score))
