"""A panel study: one rule over all symbols, with folds on common dates and one observation an entry date.

Symbols move together, so trades entered on one date are not independent: their mean is the observation that is tested. Folds split
the union of all symbols' bar times, so that no symbol's test period overlaps another's training period; each symbol then sees a fold
as the range of its own rows between the fold's dates, and everything from there on (candidates, walk-forward, tests, verdict) is the study of
pairs (``*``, rule).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marketlab.operators import study
from marketlab.sources.store import settled

ALL = "*"


def frontiers(bars: DataFrame, out_of_sample: float = 0.3, windows: int = 5) -> DataFrame:
    """name, ts: where the union of bar times is split (``oos``), and where each walk-forward window begins (``1`` to ``windows + 1``).

    Times are ranked inside ranges and ranges are counted, so no task sees all of them.
    """
    placed = settled(bars.select("ts").distinct().repartitionByRange("ts").withColumn("part", F.spark_partition_id()), "stamps")
    parts = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("ts").alias("low"))
    starts = parts.select("part", (F.sum("n").over(W.orderBy("low")) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy()).alias("all"))  # a row a partition
    ranked = placed.join(starts, "part").withColumn("i", F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("ts")) - 1)
    n = F.col("all").cast("double")
    at = [("oos", F.floor(n * F.lit(1 - out_of_sample)))] + [(str(k), F.least(F.floor(F.lit(k) * (n / (windows + 1))), F.col("all") - 1)) for k in range(1, windows + 2)]
    named = F.filter(F.array(*(F.struct(F.lit(name).alias("name"), i.cast("long").alias("i")) for name, i in at)), lambda s: s["i"] == F.col("i"))
    return ranked.select("ts", F.explode(named).alias("s")).select(F.col("s.name").alias("name"), "ts")


def fold_bounds(bars: DataFrame, out_of_sample: float = 0.3, windows: int = 5) -> DataFrame:
    """symbol, fold, lo, hi, n_bars as study.fold_bounds() has them, but with folds that begin and end on the same dates for every symbol."""
    edge = {r["name"]: r["us"] for r in frontiers(bars, out_of_sample, windows).select("name", F.unix_micros("ts").alias("us")).collect()}  # a handful
    spans = [("full", None, None), ("is", None, "oos"), ("oos", "oos", None)]
    spans += [r for k in range(1, windows + 1) for r in ((f"train_{k}", None, str(k)), (f"test_{k}", str(k), str(k + 1) if k < windows else None))]
    before = lambda name: F.count(F.when(F.unix_micros("ts") < F.lit(edge.get(name, 0)), 1))
    # Rows up to each frontier, counted in one pass over the bars.
    counted = bars.groupBy("symbol").agg(F.count("*").alias("_n"), *(before(name).alias(f"_{name}") for name in ("oos", *map(str, range(1, windows + 2)))))
    row = lambda name, other: F.col(f"_{name}") if name else other
    of = F.array(*(F.struct(F.lit(fold).alias("fold"), row(lo, F.lit(0).cast("long")).alias("lo"), row(hi, F.col("_n")).alias("hi")) for fold, lo, hi in spans))
    out = counted.select("symbol", F.inline(of))
    return out.withColumn("n_bars", F.col("hi") - F.col("lo")).where("n_bars >= 2")


def pooled(trades: DataFrame) -> DataFrame:
    """Observations of (``*``, rule, variant, fold): the means of the trades entered at one time, as rows a study reads."""
    by_date = trades.groupBy("rule", "variant", "fold", "entry_ts").agg(F.avg("net_return").alias("net_return"), F.avg("gross_return").alias("gross_return"), F.max("exit_ts").alias("exit_ts"), F.count("*").alias("n_trades"))
    return by_date.withColumns({"symbol": F.lit(ALL), "regime": F.lit(None).cast("string")})


def research(trades: DataFrame, grid: DataFrame, q: float = 0.05, min_trades: int = 30, sims: int = 5000, worst: float = -0.2, windows: int = 5) -> DataFrame:
    """A verdict for each rule over the whole panel, with ``decision``, and the trades that its frozen test pooled (``n_trades_total``, ``trades_by_symbol``).

    trades: symbol, rule, variant, fold, entry_ts, exit_ts, gross_return, net_return; grid: rule, variant, idx.
    """
    observed = settled(pooled(trades), "observations")
    pairs = grid.select(F.lit(ALL).alias("symbol"), "rule", "variant", "idx").distinct()
    nowhere = pairs.select("symbol").limit(0).withColumn("regime", F.lit(None).cast("string"))  # regimes differ across symbols: neutral
    rows = study.research_pairs(observed, pairs, nowhere, q, min_trades, sims, worst, windows)
    own = trades.where("fold = 'oos'").join(rows.select("rule", F.col("selected").alias("variant")), ["rule", "variant"], "left_semi")
    counts = own.groupBy("rule", "symbol").agg(F.count("*").alias("n"))
    counts = counts.groupBy("rule").agg(F.sum("n").alias("n_trades_total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", "n")))).alias("trades_by_symbol"))
    out = rows.join(counts, "rule", "left").fillna(0, ["n_trades_total"])
    return out.withColumn("decision", F.when(F.size("failed") == 0, "CHALLENGER_CANDIDATE").otherwise("REJECTED"))
