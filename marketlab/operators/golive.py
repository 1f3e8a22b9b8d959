"""The go-live gate: what a run on paper has to show before real money, criterion by criterion.

Every criterion is an aggregate by run, so all runs are judged in one plan; nothing is switched on by passing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlab.operators import ledger, stats

DAY_US = 86_400_000_000


# The limits, and below the names of the ten criteria and what each asks for.
@dataclass(frozen=True)
class Gate:
    min_days: float = 28.0
    min_trades: int = 50
    max_p_value: float = 0.05
    weeks: int = 4
    min_positive_weeks: int = 3
    session_gap_s: float = 3600.0


def figures(runs: DataFrame, equity: DataFrame, trips: DataFrame, events: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """A row a run with what the criteria look at.

    runs: run_id, now, max_drawdown (limit of its risk profile), external (orders go to a broker). equity: run_id, ts, equity, buy_hold. trips: run_id, book, exit_ts,
    net_return, pnl; those of the paper book count. events: run_id, ts, seq, kind. A run that a table does not know has no days, trades or events there.
    """
    now = F.broadcast(runs.select("run_id", F.unix_micros("now").alias("_now")))
    age = equity.groupBy("run_id").agg(F.min(F.unix_micros("ts")).alias("_first"))
    paper = trips.where("book = 'paper'").join(now, "run_id")
    ago = F.floor((F.col("_now") - F.unix_micros("exit_ts") - 1) / (7 * DAY_US))
    # One pass over trips: totals, and the sum of each week that ends at now.
    weekly = [F.coalesce(F.sum(F.when(ago == k, F.col("pnl"))), F.lit(0.0)).alias(f"_week{k}") for k in range(gate.weeks)]
    totals = paper.groupBy("run_id").agg(F.sum("pnl").alias("net"), F.count("*").alias("trades"), F.min("net_return").alias("_low"), F.max("net_return").alias("_high"), *weekly)
    p = stats.mean_test(stats.payoffs(paper, "run_id")).select("run_id", "p", "n")
    sessions = events.where("kind = 'session_start'").select("run_id", "ts")
    factors = ledger.session_factors(equity, sessions, gate.session_gap_s)
    # An account that fell to nothing has lost all, whatever came after.
    ruined = factors.groupBy("run_id").agg((F.min("equity_factor") <= 0).alias("_ruined"))
    grown = ledger.growth(factors)
    counted = events.groupBy("run_id").agg(F.count(F.when(F.col("kind") == "reconciliation_mismatch", 1)).alias("mismatches"))
    out = runs
    for part in (age, totals, p, grown, ruined, counted, ledger.switch_tested(events)):
        out = out.join(part, "run_id", "left")
    flag, zero = lambda c: F.coalesce(c, F.lit(False)), lambda c: F.coalesce(c, F.lit(0))
    positive = sum((F.when(F.col(f"_week{k}") > 0, 1).otherwise(0) for k in range(gate.weeks)), F.lit(0))
    tells = (F.col("n") >= 3) & (F.col("_low") < F.col("_high"))
    return out.select(
        "run_id", "now", "max_drawdown", flag("external").alias("external"), F.coalesce((F.unix_micros("now") - F.col("_first")) / DAY_US, F.lit(0.0)).alias("days"), zero("trades").alias("trades"), F.coalesce("net", F.lit(0.0)).alias("net"),
        F.coalesce(F.nanvl(F.when(tells, F.col("p")), F.lit(1.0)), F.lit(1.0)).alias("p"), positive.cast("long").alias("positive_weeks"), zero("steps").alias("steps"), F.when(flag("_ruined"), -1.0).otherwise(F.col("strategy")).alias("strategy"), "benchmark",
        F.when(flag("_ruined"), 1.0).otherwise(F.col("drawdown")).alias("drawdown"), zero("mismatches").alias("mismatches"), flag("tested").alias("switch_tested"),
    )


def criteria(figures_: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """run_id, place, criterion, ok, value, target, progress (0 to 1; below 1 unless ok): ten rows a run."""
    c, number = F.col, lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    none, moved = F.lit(0.0), c("steps") > 0
    weeks_known = F.floor(c("days") / 7)
    ten = [
        ("days", c("days") >= gate.min_days, c("days"), gate.min_days, c("days") / gate.min_days),
        ("trades", c("trades") >= gate.min_trades, c("trades"), gate.min_trades, c("trades") / gate.min_trades),
        ("net", (c("trades") > 0) & (c("net") > 0), c("net"), 0.0, none),
        ("edge", c("p") < gate.max_p_value, c("p"), gate.max_p_value, (1 - c("p")) / (1 - gate.max_p_value)),
        ("consistency", (c("days") >= gate.weeks * 7) & (c("positive_weeks") >= gate.min_positive_weeks), c("positive_weeks"), gate.min_positive_weeks, F.least(c("positive_weeks"), weeks_known) / gate.min_positive_weeks),
        ("buy_hold", moved & (c("strategy") > c("benchmark")), c("strategy"), c("benchmark"), none),
        ("drawdown", moved & (c("drawdown") <= c("max_drawdown")), c("drawdown"), c("max_drawdown"), F.when(moved & (c("drawdown") > 0), c("max_drawdown") / F.nullif("drawdown", F.lit(0.0))).otherwise(0.0)),
        ("venue", c("external"), c("external").cast("int"), 1.0, none),
        ("reconciliation", c("external") & (c("mismatches") == 0), c("mismatches"), 0.0, none),
        ("kill_switch", c("switch_tested"), c("switch_tested").cast("int"), 1.0, none),
    ]
    rows = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(name).alias("criterion"), F.coalesce(ok, F.lit(False)).alias("ok"), number(value).alias("value"), number(target).alias("target"), F.coalesce(F.nanvl(number(near), none), none).alias("_near")) for k, (name, ok, value, target, near) in enumerate(ten)))
    out = figures_.select("run_id", F.inline(rows))
    return out.withColumn("progress", F.when(c("ok"), 1.0).otherwise(F.greatest(none, F.least(F.lit(0.99), "_near")))).drop("_near")


def verdict(criteria_: DataFrame) -> DataFrame:
    """run_id, passed, total, ready, progress (mean over the criteria), missing (names of what is not there yet, in order)."""
    gaps = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("place", "criterion"))))
    out = criteria_.groupBy("run_id").agg(F.count(F.when(F.col("ok"), 1)).alias("passed"), F.count("*").alias("total"), F.avg("progress").alias("progress"), F.array_join(F.transform(gaps, lambda g: g["criterion"]), ", ").alias("missing"))
    return out.withColumn("ready", F.col("passed") == F.col("total"))
