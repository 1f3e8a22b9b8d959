"""As-of joins, range counts and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def asof(left: DataFrame, right: DataFrame, value: str, forward: bool = False, key: str = "symbol", order: str = "ts", tie: str | None = "seq") -> DataFrame:
    """left with ``value`` of the last row of right at or before its time (forward: the first at or after); equal times go by ``tie``."""
    tie_ = F.col(tie) if tie and tie in right.columns else F.lit(0)
    l, r = left.withColumns({"_side": F.lit(1), "_tie": F.lit(0).cast("long")}), right.select(key, order, F.col(value), F.lit(0).alias("_side"), tie_.cast("long").alias("_tie"))
    both = l.unionByName(r, allowMissingColumns=True)
    # Rows of right come before the rows they answer, also at equal times. Forward runs backwards in time: a frame that
    # ends at the current row is filled in one pass, one that begins there is read anew for every row.
    w = W.partitionBy(key).orderBy(F.desc(order) if forward else F.asc(order), F.asc("_side"), F.desc("_tie") if forward else F.asc("_tie"))
    filled = F.last(F.when(F.col("_side") == 0, F.col(value)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn(value, filled).where("_side = 1").drop("_side", "_tie")


def range_counts(bars: DataFrame, events: DataFrame, days: tuple[int, ...], key: str = "symbol") -> DataFrame:
    """Events of a bar's symbol in (ts - d days, ts], for each d: the running count up to a bar less the one up to the window's start.

    A bar asks once for each end of its windows, so rows grow with bars and events, not with their pairs.
    """
    ends = [("_n", "ts")] + [(f"_n_{d}", F.expr(f"ts - interval {d} days")) for d in days]
    asks = bars.select(key, "ts").distinct()
    marks = asks.select(key, F.col("ts").alias("_of"), F.explode(F.array(*(F.struct(F.lit(n).alias("end"), (F.col(t) if isinstance(t, str) else t).alias("at")) for n, t in ends))).alias("m"))
    both = marks.select(key, "_of", F.col("m.end").alias("end"), F.col("m.at").alias("at")).unionByName(events.select(key, F.col("ts").alias("at")), allowMissingColumns=True)
    upto = F.count(F.when(F.col("end").isNull(), 1)).over(W.partitionBy(key).orderBy("at").rangeBetween(W.unboundedPreceding, 0))
    wide = both.withColumn("_c", upto).where("end is not null").groupBy(key, F.col("_of").alias("ts")).agg(*(F.max(F.when(F.col("end") == n, F.col("_c"))).alias(n) for n, _ in ends))
    counts = wide.select(key, "ts", *((F.col("_n") - F.col(f"_n_{d}")).alias(f"n_{d}d") for d in days))
    return bars.join(counts, [key, "ts"], "left").fillna(0, [f"n_{d}d" for d in days])


def reconcile(left: DataFrame, right: DataFrame, key: str = "symbol", value: str = "quantity", tolerance: float = 1e-9) -> DataFrame:
    """Rows that differ between two books."""
    both = left.select(key, F.col(value).alias("left_value")).join(right.select(key, F.col(value).alias("right_value")), key, "full_outer")
    apart = F.abs(F.col("left_value") - F.col("right_value")) > tolerance * F.greatest(F.abs("left_value"), F.abs("right_value"))
    return both.where(F.col("left_value").isNull() | F.col("right_value").isNull() | apart)
