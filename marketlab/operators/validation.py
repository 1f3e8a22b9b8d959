"""Splits, folds and false-discovery control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def chronological_split(bars: DataFrame, out_of_sample: float = 0.3) -> DataFrame:
    """Adds ``fold``: is before int(n (1 - f)) rows of a symbol, oos from there on."""
    i, n = F.row_number().over(W.partitionBy("symbol").orderBy("ts")), F.count("*").over(W.partitionBy("symbol"))
    return bars.withColumn("fold", F.when(i <= F.floor(n * F.lit(1 - out_of_sample)), "is").otherwise("oos"))


def purged_folds(bars: DataFrame, k: int = 5, embargo: int = 2) -> DataFrame:
    """A row for each bar and fold: test inside the fold, train outside it and its embargo."""
    rows = bars.withColumn("i", F.row_number().over(W.partitionBy("symbol").orderBy("ts")) - 1).withColumn("n", F.count("*").over(W.partitionBy("symbol")))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    lo, hi = F.floor(F.col("n") * F.col("k") / k), F.floor(F.col("n") * (F.col("k") + 1) / k)
    part = F.when((F.col("i") >= lo) & (F.col("i") < hi), "test").when((F.col("i") < lo - embargo) | (F.col("i") >= hi + embargo), "train")
    return rows.withColumn("part", part).where("part is not null").drop("n")


def benjamini_hochberg(tests: DataFrame, p: str = "p", alpha: float = 0.05, *groups: str) -> DataFrame:
    """Adds ``p_adjusted`` and ``rejected`` by group.

    The reverse running minimum is taken over distinct p-values in descending order; equal ones share a rank.
    """
    m = F.count(p).over(W.partitionBy(*groups)) if groups else F.count(p).over(W.partitionBy(F.lit(0)))
    over = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    at_most = F.count(p).over(over.orderBy(p).rangeBetween(W.unboundedPreceding, 0))
    raw = tests.withColumn("_raw", F.col(p) * m / at_most)
    return raw.withColumn("p_adjusted", F.least(F.lit(1.0), F.min("_raw").over(over.orderBy(F.desc(p)).rangeBetween(W.unboundedPreceding, 0)))).withColumn("rejected", F.col("p_adjusted") <= alpha).drop("_raw")
