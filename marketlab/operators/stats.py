"""Tests, posteriors and scores of aggregated returns. Tail functions run in Arrow batches on rows that are aggregates already."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window as W

_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz), all elements at once."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    turn = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turn, b, a), np.where(turn, a, b), np.clip(np.where(turn, 1 - x, x), 0.0, 1.0)
    with np.errstate(divide="ignore"):
        front = np.exp((_lgamma(p + q) - _lgamma(p) - _lgamma(q)).astype(float) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    value = np.where(z <= 0, 0.0, front * h)
    return np.where(turn, 1 - value, value)


def beta_quantile(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    lo, hi = np.zeros(len(a)), np.ones(len(a))
    for _ in range(60):
        mid = (lo + hi) / 2
        up = incomplete_beta(a, b, mid) < p
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


@pandas_udf(T.DoubleType())
def student_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(T > t) of Student's distribution; null in, null out."""
    ok = t.notna() & df.notna()
    x, n = t[ok].astype(float), df[ok].astype(float)
    half = incomplete_beta(n / 2, np.full(len(n), 0.5), n / (n + x * x)) / 2
    return pd.Series(np.where(x >= 0, half, 1 - half), index=t.index[ok], dtype=float).reindex(t.index)


@pandas_udf(T.DoubleType())
def student_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    """t with P(T <= t) = p, for p above one half."""
    ok = p.notna() & df.notna()
    n = df[ok].astype(float).to_numpy()
    # 2 (1 - p) is the incomplete beta function at df / (df + t^2).
    lo, hi = np.zeros(len(n)), np.ones(len(n))
    want = 2 * (1 - p[ok].astype(float).to_numpy())
    for _ in range(80):
        mid = (lo + hi) / 2
        up = incomplete_beta(n / 2, np.full(len(n), 0.5), mid) < want
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    z = (lo + hi) / 2
    return pd.Series(np.sqrt(n * (1 - z) / z), index=p.index[ok], dtype=float).reindex(p.index)


@pandas_udf(T.DoubleType())
def beta_tail(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """P(X > x) of the beta distribution."""
    return pd.Series(1 - incomplete_beta(a.to_numpy(float), b.to_numpy(float), x.to_numpy(float)), index=x.index)


@pandas_udf(T.DoubleType())
def beta_low(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_quantile(a.to_numpy(float), b.to_numpy(float), 0.025), index=a.index)


@pandas_udf(T.DoubleType())
def beta_high(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_quantile(a.to_numpy(float), b.to_numpy(float), 0.975), index=a.index)


def payoffs(returns: DataFrame, *keys: str, value: str = "net_return") -> DataFrame:
    """n, wins, mean, sd, avg_win and avg_loss (zero returns are losses) of each group."""
    r = F.col(value)
    return returns.groupBy(*keys).agg(
        F.count(r).alias("n"), F.count(F.when(r > 0, 1)).alias("wins"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(r <= 0, -r)), F.lit(0.0)).alias("avg_loss")
    )


def mean_test(groups: DataFrame) -> DataFrame:
    """One-sided test of mean > 0 on payoffs(): adds ``t``, ``p``, ``ci_low`` and ``ci_high``; fewer than two returns: p is 1; no spread: 0 or 1."""
    error = F.col("sd") / F.sqrt("n")
    t = F.when((F.col("n") >= 2) & (error > 0), F.col("mean") / F.nullif(error, F.lit(0.0)))
    p = F.when(F.col("n") < 2, 1.0).when(error == 0, F.when(F.col("mean") > 0, 0.0).otherwise(1.0)).otherwise(student_tail(t, F.col("n") - 1))
    half = error * student_quantile(F.when(F.col("n") >= 2, 0.975), F.col("n") - 1)
    return groups.withColumns({"t": t, "p": p, "ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def posterior(groups: DataFrame) -> DataFrame:
    """Beta(1 + wins, 1 + losses): ``p_win``, ``p_win_sd``, its interval, ``breakeven`` win rate, and ``p_positive``, the chance that the win rate beats it."""
    a, b = (1 + F.col("wins")).cast("double"), (1 + F.col("n") - F.col("wins")).cast("double")
    total = F.col("avg_win") + F.col("avg_loss")
    even = F.when(total > 0, F.col("avg_loss") / F.nullif(total, F.lit(0.0))).otherwise(1.0)
    return groups.withColumns({"p_win": a / (a + b), "p_win_sd": F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), "p_win_low": beta_low(a, b), "p_win_high": beta_high(a, b), "breakeven": even}).withColumn("p_positive", beta_tail(F.col("breakeven"), a, b))


def edge_score(n: Column, mean: Column, avg_loss: Column, p: Column, p_positive: Column, compatibility: Column | float = 1.0, min_trades: int = 30) -> Column:
    """0 to 100; 0 without a positive mean."""
    compatibility = compatibility if isinstance(compatibility, Column) else F.lit(float(compatibility))
    quality = F.when(avg_loss > 0, F.tanh(mean / (avg_loss + 1e-9))).otherwise(1.0)
    score = 100 * F.greatest(F.lit(0.0), 1 - p) * F.least(F.lit(1.0), n / F.lit(float(min_trades))) * F.least(F.greatest(compatibility, F.lit(0.0)), F.lit(1.0)) * quality * p_positive
    return F.when((n == 0) | (mean <= 0) | mean.isNull(), 0.0).otherwise(score)


def regime_compatibility(by_regime: DataFrame, current: DataFrame, key: str, least: int = 5) -> DataFrame:
    """1 or 0 as the mean of the current regime's trades is positive or not; 0.5 if it is unknown or has fewer than ``least`` trades."""
    now = current.select(key, F.col("regime").alias("_now"))
    own = by_regime.select(F.col(key).alias("_k"), "regime", "n", "mean")
    joined = now.join(own, (now[key] == F.col("_k")) & (F.col("_now") == F.col("regime")), "left")
    return joined.select(key, F.when(F.col("n").isNull() | (F.col("n") < least), 0.5).when(F.col("mean") > 0, 1.0).otherwise(0.0).alias("compatibility"))


def last_returns(trips: DataFrame, key: str, order: tuple[str, ...], n: int = 500) -> DataFrame:
    """The n latest rows of each key."""
    w = W.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return trips.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def evidence(trips: DataFrame, key: str = "strategy", order: tuple[str, ...] = ("exit_ts", "seq"), window: int = 500, fees: float = 0.003, min_trades: int = 30) -> DataFrame:
    """Evidence of every strategy from its latest returns: test, p-value adjusted across strategies, edge score, gross edge (null below two returns)."""
    from marketlab.operators.validation import benjamini_hochberg

    rows = posterior(mean_test(payoffs(last_returns(trips, key, order, window), key)))
    rows = benjamini_hochberg(rows, "p")
    score = edge_score(F.col("n"), F.col("mean"), F.col("avg_loss"), F.col("p_adjusted"), F.col("p_positive"), 1.0, min_trades)
    gross = F.when(F.col("n") >= 2, F.col("mean") + fees)
    return rows.select(key, "n", (F.col("wins") / F.col("n")).alias("win_rate"), "mean", "p", "p_adjusted", (1 - F.col("p_adjusted")).alias("confidence"), score.alias("edge_score"), "p_win", "avg_win", "avg_loss", gross.alias("gross_edge"), "p_positive")
