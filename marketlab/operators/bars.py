"""Bars from trades and quotes, coarser bars, gap filling, and bar checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Slack of the checks on highs and lows.
TOLERANCE = 1e-9


def resample_trades(trades: DataFrame, rule: str) -> DataFrame:
    """Tumbling OHLCV bars (left-closed, UTC) with the volume that aggressive buyers took."""
    bucket = F.window("ts", rule)["start"]
    order = F.struct("ts", "seq")
    return trades.groupBy("symbol", bucket.alias("bar")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"), F.sum(F.when(~F.col("buyer_is_maker"), F.col("qty")).otherwise(0.0)).alias("taker_buy_volume"),
    ).withColumnRenamed("bar", "ts")


def resample_bars(bars: DataFrame, rule: str) -> DataFrame:
    """Coarser bars from finer ones."""
    return bars.groupBy("symbol", F.window("ts", rule)["start"].alias("bar")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.sum("taker_buy_volume").alias("taker_buy_volume")
    ).withColumnRenamed("bar", "ts")


def tick_bars(quotes: DataFrame, trades: DataFrame, rule: str) -> DataFrame:
    """Bars of quote mids with traded volume by side and the last book.

    Crossed and empty quotes do not count, nor trades before a symbol's first quote. A bar in which only trades came stays at the close and the book before it.
    """
    good = quotes.where("bid > 0 and ask >= bid").select("symbol", "ts", "seq", ((F.col("bid") + F.col("ask")) / 2).alias("mid"), "bid", "ask", "bid_qty", "ask_qty")
    first = good.groupBy("symbol").agg(F.min(F.struct("ts", "seq")).alias("first"))
    done = trades.join(first, "symbol").where(F.struct("ts", "seq") >= F.col("first")).select("symbol", "ts", "seq", "qty", "buyer_is_maker")
    both = good.unionByName(done, allowMissingColumns=True)
    order = F.when(F.col("mid").isNotNull(), F.struct("ts", "seq"))
    traded = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    found = both.groupBy("symbol", F.window("ts", rule)["start"].alias("bar")).agg(
        F.min_by("mid", order).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", order).alias("close"),
        traded("qty").alias("volume"), traded(F.when(~F.col("buyer_is_maker"), F.col("qty"))).alias("buy_volume"), traded(F.when(F.col("buyer_is_maker"), F.col("qty"))).alias("sell_volume"), F.count("qty").alias("n_trades"),
        *(F.max_by(of, order).alias(name) for of, name in (("bid", "last_bid"), ("ask", "last_ask"), ("bid_qty", "bid_qty"), ("ask_qty", "ask_qty"))),
    ).withColumnRenamed("bar", "ts")
    carried = lambda c: F.last(c, ignorenulls=True).over(W.partitionBy("symbol").orderBy("ts").rowsBetween(W.unboundedPreceding, 0))
    close = carried("close")
    return found.withColumns({**{c: F.coalesce(c, close) for c in ("open", "high", "low", "close")}, **{c: carried(c) for c in ("last_bid", "last_ask", "bid_qty", "ask_qty")}})


def fill_quiet(bars: DataFrame, seconds: int, most: int = 120) -> DataFrame:
    """Flat bars (previous close and book, no volume) for quiet intervals.

    Outages of more than ``most`` bars stay open; ``outages`` counts those of a symbol that lie before a bar.
    """
    w = W.partitionBy("symbol").orderBy("ts")
    missing = lambda a, b: ((F.unix_timestamp(b) - F.unix_timestamp(a)) / seconds - 1).cast("int")
    out = F.coalesce(missing(F.lag("ts").over(w), "ts"), F.lit(0)) > most
    known = bars.withColumns({"outages": F.sum(out.cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)), "_missing": missing("ts", F.lead("ts").over(w))})
    flat = known.where(F.col("_missing").between(1, most)).withColumn("_k", F.explode(F.sequence(F.lit(1), "_missing"))).withColumn("ts", F.timestamp_seconds(F.unix_timestamp("ts") + F.col("_k") * seconds))
    zero = {c: F.lit(0).cast(t) for c, t in known.dtypes if c in ("volume", "buy_volume", "sell_volume", "taker_buy_volume", "n_trades")}
    flat = flat.withColumns({**{c: F.col("close") for c in ("open", "high", "low")}, **zero})
    return known.drop("_missing").unionByName(flat.drop("_missing", "_k"))


def violations(bars: DataFrame) -> DataFrame:
    """One row per broken rule of a bar: rule, symbol, ts."""
    w = W.partitionBy("symbol").orderBy("ts")
    price = ("open", "high", "low", "close")
    missing = F.lit(False)
    for c in (*price, "volume"):
        missing = missing | F.col(c).isNull()
    rules = {
        "missing": missing,
        "not_positive": F.least(*price) <= 0,
        "high_too_low": F.col("high") < F.greatest("open", "close", "low") - TOLERANCE,
        "low_too_high": F.col("low") > F.least("open", "close") + TOLERANCE,
        "negative_volume": F.col("volume") < 0,
        "repeated_time": F.lag("ts").over(w) >= F.col("ts"),
    }
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))
    return bars.withColumn("rule", found).select(F.explode("rule").alias("rule"), "symbol", "ts")
