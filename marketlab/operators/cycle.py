"""What a research cycle over several timeframes leaves behind: its summary, confirmation on quotes, and what became of proposed hypotheses.

A pair is a (timeframe, symbol, strategy) that was studied: n_hypotheses, decision, oos_ev, oos_trades, failed (names of checks). One whose study could not run has a null
n_hypotheses: it counts as a pair and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marketlab.operators import ticks

CANDIDATE = "CHALLENGER_CANDIDATE"


def cycle_summary(pairs: DataFrame, *keys: str) -> DataFrame:
    """pairs, studied, hypotheses, discoveries (where ``discoveries`` is a column) and candidates by keys, as by timeframe; without keys of the whole cycle."""
    found = F.coalesce(F.sum("discoveries"), F.lit(0)).alias("discoveries") if "discoveries" in pairs.columns else F.lit(0).cast("long").alias("discoveries")
    return pairs.groupBy(*keys).agg(F.count("*").alias("pairs"), F.count("n_hypotheses").alias("studied"), F.coalesce(F.sum("n_hypotheses"), F.lit(0)).alias("hypotheses"), found, F.count(F.when(F.col("decision") == CANDIDATE, 1)).alias("candidates"))


def failed_checks(pairs: DataFrame, *keys: str) -> DataFrame:
    """How many studied pairs failed each check, and the check's place by that number (ties by name)."""
    counts = pairs.where("n_hypotheses is not null").select(*keys, F.explode("failed").alias("check")).groupBy(*keys, "check").agg(F.count("*").alias("n"))
    # A few checks by key: their order is one small window.
    return counts.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "check")))


def bar_counts(bars: DataFrame) -> DataFrame:
    """Bars, first and last time of every timeframe and symbol."""
    return bars.groupBy("timeframe", "symbol").agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def confirm(candidates: DataFrame, signals: DataFrame, quotes: DataFrame, least: int = 5, latency_s: float = 0.25, fee: float = 0.001) -> DataFrame:
    """Candidates once more on quotes, with latency, spread and fees, over the time that chose nothing: strategy, n_trades, mean_net_return, win_rate, passed.

    candidates: strategy, oos_start. signals: strategy, symbol, ts, stop_pct, target_pct, hold_s; those from oos_start on are traded. The trades of all symbols of a strategy are
    judged together. One without any trade does not pass. A signal given twice is traded once.
    """
    own = candidates.select("strategy", "oos_start")
    late = signals.join(F.broadcast(own), "strategy").where("ts >= oos_start").drop("oos_start")
    # No trade begins before the first oos_start of a strategy with signals: quotes from before it fill nothing and are not sent to the tasks of their symbols.
    both = own.withColumn("_asked", F.lit(False)).unionByName(signals.select("strategy", F.lit(None).cast(own.schema["oos_start"].dataType).alias("oos_start"), F.lit(True).alias("_asked")))
    start = both.groupBy("strategy").agg(F.min("oos_start").alias("_from"), F.max("_asked").alias("_asked")).where("_asked").agg(F.min("_from"))
    trades = ticks.shadow_trades(late, quotes.where(F.col("ts") >= start.scalar()), latency_s, fee).groupBy(F.col("strategy").alias("_s")).agg(F.count("*").alias("_n"), F.avg("net_return").alias("_m"), F.avg((F.col("net_return") > 0).cast("double")).alias("_w"))
    zero = lambda c, x: F.coalesce(c, F.lit(x))
    out = own.join(trades, F.col("strategy") == F.col("_s"), "left").select("strategy", zero("_n", 0).alias("n_trades"), zero("_m", 0.0).alias("mean_net_return"), zero("_w", 0.0).alias("win_rate"))
    return out.withColumn("passed", (F.col("n_trades") >= least) & (F.col("mean_net_return") > 0))


def write_back(hypotheses: DataFrame, pairs: DataFrame, rules: DataFrame, top: int = 4) -> DataFrame:
    """What the cycle concludes about each proposed hypothesis.

    hypotheses: hypothesis, strategy. rules: timeframe, symbol, strategy, rule, promoted: pairs that were confirmed and the rule each became. Gives hypothesis, symbols_tested, best_symbol,
    best_oos_ev, best_oos_trades (of the best studied pair; no result counts as the worst, ties by timeframe and symbol), candidates, rules (in order), failed_checks (the ``top`` commonest, as name and n) and status.
    """
    studied = pairs.where("n_hypotheses is not null")
    keys = ["timeframe", "symbol", "strategy"]
    both = hypotheses.join(studied, "strategy", "left").join(rules.select(*keys, "rule", "promoted"), keys, "left")
    order = F.struct((-F.coalesce("oos_ev", F.lit(float("-inf")))).alias("k"), "timeframe", "symbol")
    tested = F.col("symbol").isNotNull()
    best = lambda c: F.min_by(c, F.when(tested, order))
    out = both.groupBy("hypothesis", "strategy").agg(
        F.count("symbol").alias("symbols_tested"), best("symbol").alias("best_symbol"), best("oos_ev").alias("best_oos_ev"), best("oos_trades").alias("best_oos_trades"), F.count(F.when(F.col("decision") == CANDIDATE, 1)).alias("candidates"),
        F.array_sort(F.collect_set("rule")).alias("rules"), F.when(F.coalesce(F.max("promoted"), F.lit(False)), "promoted").otherwise("rejected").alias("status"),
    )
    worst = failed_checks(studied, "strategy").where(F.col("place") <= top).groupBy("strategy").agg(F.array_sort(F.collect_list(F.struct("place", "check", "n"))).alias("_f"))
    named: Column = F.transform(F.coalesce("_f", F.array().cast("array<struct<place:int,check:string,n:bigint>>")), lambda f: F.struct(f["check"].alias("check"), f["n"].alias("n")))
    return out.join(worst, "strategy", "left").withColumn("failed_checks", named).drop("_f")


def report_extract(lessons: DataFrame, runs: DataFrame, trips: DataFrame, proposals: DataFrame) -> DataFrame:
    """What a report on the next cycle may read: part, place, name, text, n, mean, win_rate.

    lesson: the 15 latest of lessons (seq, text). pair: the first 8 of the last done run of runs (seq, status, top_pairs: array of names). forward: the 20 strategies with most trips (strategy,
    net_return; ties by name). proposal: the 20 latest of proposals (seq, name, status, claim), claims cut to 160 characters. A part without rows is absent.
    """
    nothing, none = F.lit(None).cast("string"), F.lit(None).cast("double")
    shape = lambda rows, part, name, text, n=F.lit(None).cast("long"), mean=none, rate=none: rows.select(F.lit(part).alias("part"), F.col("place").cast("int").alias("place"), name.alias("name"), text.alias("text"), n.alias("n"), mean.alias("mean"), rate.alias("win_rate"))
    # Limits first: only their few rows are numbered in one task.
    latest = lambda rows, k, *order: rows.orderBy(*order).limit(k).withColumn("place", F.row_number().over(W.orderBy(*order)))
    last = runs.where("status = 'done'").agg(F.max_by("top_pairs", "seq").alias("_p")).select(F.posexplode(F.slice("_p", 1, 8)).alias("_i", "name")).withColumn("place", F.col("_i") + 1)
    by = trips.groupBy("strategy").agg(F.count("*").alias("n"), F.avg("net_return").alias("mean"), F.avg((F.col("net_return") > 0).cast("double")).alias("rate"))
    return (
        shape(latest(lessons, 15, F.desc("seq")), "lesson", nothing, F.col("text")).unionByName(shape(last, "pair", F.col("name"), nothing))
        .unionByName(shape(latest(by, 20, F.desc("n"), F.col("strategy")), "forward", F.col("strategy"), nothing, F.col("n"), F.col("mean"), F.col("rate")))
        .unionByName(shape(latest(proposals, 20, F.desc("seq")), "proposal", F.col("name"), F.concat_ws(": ", "status", F.substring("claim", 1, 160))))
    )
