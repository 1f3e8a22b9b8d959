"""Trades from signals on bars: one position at a time for a symbol and variant.

The exit of an entry depends on its entry row alone, so every candidate's exit is found in parallel (a join of
entries to the bars they may be held over, and the first row that ends them); a pass over the candidates of
a (symbol, variant) in order of entry then keeps those that start after the trade before has ended.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marketlab.functions.columns import effective_buy, effective_sell

SLOT = 32


def candidates(bars: DataFrame, variants: DataFrame, entry: Column, leave: Column) -> DataFrame:
    """One row per possible entry with its exit.

    bars: features with atr. variants: variant, stop_atr, target_atr (null: none), hold (null: as long as the bars last), and the parameters that
    the Columns ``entry`` and ``leave`` read. A rules table is small: it is crossed with the bars of a symbol.
    """
    w = W.partitionBy("symbol").orderBy("ts")
    rows = bars.withColumn("i", F.row_number().over(w)).withColumn("last_i", F.count("*").over(W.partitionBy("symbol")))
    # What the bar after a signal opens at is found before bars meet variants, so that nothing is shuffled a variant.
    ahead = rows.withColumn("entry_ts", F.lead("ts").over(w)).withColumn("entry_price", F.lead("open").over(w))
    entries = ahead.crossJoin(F.broadcast(variants)).where(F.coalesce(entry, F.lit(False)) & F.col("atr").isNotNull() & F.col("entry_price").isNotNull())
    entries = entries.select("symbol", "last_i", *variants.columns, (F.col("i") + 1).alias("entry_i"), "entry_ts", "entry_price", (F.col("entry_price") - F.col("stop_atr") * F.col("atr")).alias("stop"), (F.col("entry_price") + F.col("target_atr") * F.col("atr")).alias("target"))
    # Bars meet entries in slots of SLOT rows: an entry lists the slots it may be held over.
    spread = entries.withColumn("slot", F.explode(F.sequence(F.floor(F.col("entry_i") / SLOT), F.floor(F.least(F.coalesce(F.col("entry_i") + F.col("hold"), F.col("last_i")), F.col("last_i")) / SLOT))))
    # A bar carries the features of the bar before it, under their own names, for ``leave``.
    before = [F.lag(c).over(w).alias(c) for c in bars.columns if c not in ("symbol", "ts")]
    held = rows.select("symbol", "i", F.col("ts").alias("bar_ts"), *(F.col(c).alias(f"bar_{c}") for c in ("open", "high", "low", "close")), F.floor(F.col("i") / SLOT).alias("slot"), *before)
    pairs = spread.join(held, ["symbol", "slot"]).where("i >= entry_i and (hold is null or i <= entry_i + hold)").withColumn("leave", F.coalesce(leave, F.lit(False)))
    later, first = F.col("i") > F.col("entry_i"), F.col("i") == F.col("entry_i")
    struct = lambda reason, price: F.struct(F.lit(reason).alias("reason"), price.alias("price"), F.col("bar_ts").alias("ts"), F.col("i").alias("i"))
    end = (
        F.when(F.col("leave") & later, struct("signal", F.col("bar_open")))
        .when(later & (F.col("i") - F.col("entry_i") >= F.col("hold")), struct("max_holding", F.col("bar_open")))
        .when(F.col("bar_low") <= F.col("stop"), struct("stop", F.when(first, F.col("stop")).otherwise(F.least("bar_open", "stop"))))
        .when(F.col("bar_high") >= F.col("target"), struct("target", F.when(first, F.col("target")).otherwise(F.greatest("bar_open", "target"))))
        .when(F.col("i") == F.col("last_i"), struct("end_of_data", F.col("bar_close")))
    )
    ended = pairs.withColumn("end", end).where("end is not null")
    return ended.groupBy("symbol", "variant", "entry_i", "entry_ts", "entry_price").agg(F.min_by("end", "i").alias("end"))


def in_folds(found: DataFrame, folds: DataFrame, bars: DataFrame) -> DataFrame:
    """Candidates as each fold sees them: signal and entry lie inside it, and its last bar ends what is still open.

    An exit depends on bars up to it only, so candidates are found once for all folds. folds: symbol, fold, lo, hi (rows from lo up to hi, from 0).
    """
    i = F.row_number().over(W.partitionBy("symbol").orderBy("ts"))
    closes = bars.select("symbol", i.alias("hi"), F.struct(F.lit("end_of_data").alias("reason"), F.col("close").alias("price"), "ts", i.alias("i")).alias("_last"))
    seen = found.join(folds.join(closes, ["symbol", "hi"]), "symbol").where("entry_i - 2 >= lo and entry_i <= hi")
    return seen.withColumn("end", F.when(F.col("end.i") <= F.col("hi"), F.col("end")).otherwise(F.col("_last"))).select(*found.columns, "fold")


def single_position(found: DataFrame) -> DataFrame:
    """Keep a candidate when it enters after the exit of the one kept before; the exit row takes no new entry.

    A series is a symbol and variant (and fold, if there are folds). Candidates stream through in order, and a task holds only where
    the last kept one of the series at hand ended.
    """
    keys = [c for c in ("symbol", "variant", "fold") if c in found.columns]
    rows = found.select(*keys, "entry_i", "entry_ts", "entry_price", F.col("end.i").alias("exit_i"), F.col("end.ts").alias("exit_ts"), F.col("end.price").alias("exit_price"), F.col("end.reason").alias("reason"))

    def run(batches):
        series, until = None, 0
        for batch in batches:
            keep = []
            for k, (*own, entry, exit_) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*keys, "entry_i", "exit_i")))):
                if own != series:
                    series, until = own, 0
                if entry > until:
                    keep.append(k)
                    until = exit_
            yield batch.take(pa.array(keep, pa.int64()))

    return rows.repartition(*keys).sortWithinPartitions(*keys, "entry_i").mapInArrow(run, rows.schema)


def net_returns(trades: DataFrame, fee: float = 0.001, spread: float = 0.0005, slippage: float = 0.0005) -> DataFrame:
    net = effective_sell(F.col("exit_price"), fee, spread, slippage) / effective_buy(F.col("entry_price"), fee, spread, slippage) - 1
    return trades.withColumn("gross_return", F.col("exit_price") / F.col("entry_price") - 1).withColumn("net_return", net)


def metrics(trades: DataFrame, *keys: str) -> DataFrame:
    """Trade statistics by group; zero returns count as losses, and the profit factor is null without losses."""
    r = F.col("net_return")
    win, loss = F.when(r > 0, r), F.when(r <= 0, -r)
    return trades.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((r > 0).cast("double")).alias("win_rate"), F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"), F.avg(r).alias("ev"),
        F.try_divide(F.coalesce(F.sum(win), F.lit(0.0)), F.nullif(F.coalesce(F.sum(loss), F.lit(0.0)), F.lit(0.0))).alias("profit_factor"), (F.product(1 + r) - 1).alias("total_return"),
        F.try_divide(F.avg(r), F.nullif(F.stddev_samp(r), F.lit(0.0))).alias("sharpe"), F.try_divide(F.avg(r), F.nullif(F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2))), F.lit(0.0))).alias("sortino"),
    )


def bar_series(trades: DataFrame, bars: DataFrame, fee: float = 0.001, spread: float = 0.0005, slippage: float = 0.0005) -> DataFrame:
    """The bars on which positions are open: ``bar_return`` from mark to mark, and ``exposed`` (0 on a bar left at its open).

    The first bar starts at the effective entry price, the last ends at the effective exit price. All other bars of a series are 0.
    """
    w = W.partitionBy("symbol").orderBy("ts")
    closes = bars.select("symbol", F.row_number().over(w).alias("i"), F.col("ts").alias("bar_ts"), "close", F.lag("close").over(w).alias("_before"))
    held = trades.withColumn("i", F.explode(F.sequence("entry_i", "exit_i"))).join(closes, ["symbol", "i"])
    start = F.when(F.col("i") == F.col("entry_i"), effective_buy(F.col("entry_price"), fee, spread, slippage)).otherwise(F.col("_before"))
    leaves = F.col("i") == F.col("exit_i")
    end = F.when(leaves, effective_sell(F.col("exit_price"), fee, spread, slippage)).otherwise(F.col("close"))
    at_open = leaves & F.col("reason").isin("signal", "max_holding")
    return held.withColumns({"bar_return": end / start - 1, "exposed": F.when(at_open, 0.0).otherwise(1.0)}).drop("_before", "close")


def series_metrics(series: DataFrame, periods_per_year: float, *keys: str) -> DataFrame:
    """total_return, max_drawdown, sharpe, sortino and exposure of bar_series() over ``n_bars`` bars (a column), most of which hold no position."""
    run = W.partitionBy(*keys).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    r = F.col("bar_return")
    rows = series.withColumn("_eq", F.product(1 + r).over(run)).withColumn("_peak", F.greatest(F.lit(1.0), F.max("_eq").over(run)))
    n = F.col("n_bars")
    sums = rows.groupBy(*keys, "n_bars").agg(
        F.max_by("_eq", "i").alias("_end"), F.min(F.least(F.lit(0.0), F.col("_eq") / F.col("_peak") - 1)).alias("max_drawdown"), F.sum(r).alias("_s"), F.sum(r * r).alias("_q"), F.sum(F.pow(F.least(r, F.lit(0.0)), 2)).alias("_d"), F.sum("exposed").alias("_x")
    )
    mean = F.col("_s") / n
    spread_, down, year = F.sqrt(F.greatest(F.col("_q") - n * mean * mean, F.lit(0.0)) / (n - 1)), F.sqrt(F.col("_d") / n), periods_per_year**0.5
    ratio = lambda sd: F.when((n >= 2) & (sd > 0), mean / F.nullif(sd, F.lit(0.0)) * year).otherwise(0.0)
    return sums.select(*keys, (F.col("_end") - 1).alias("total_return"), "max_drawdown", ratio(spread_).alias("sharpe"), ratio(down).alias("sortino"), (F.col("_x") / n).alias("exposure"))
