"""Causal features of bars: a row uses its own bar and earlier ones of its symbol only.

A rolling value shows once its window holds as many values as it is long. All windows share one
partitioning and order, so Spark shuffles and sorts the bars once for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marketlab.functions.columns import candle_shape
from marketlab.operators.scan import smooth
from marketlab.sources.store import settled


def series():
    """Bars of a symbol in time order (needs a session, so it is not a constant)."""
    return W.partitionBy("symbol").orderBy("ts")


def last(n: int):
    """The frame of the current row and the n - 1 before it."""
    return series().rowsBetween(1 - n, 0)


def full(value: Column, of: Column | str, n: int) -> Column:
    """value, where the last n rows hold n values of ``of``."""
    return F.when(F.count(of).over(last(n)) == n, value)


def change(n: int, of: str = "close") -> Column:
    return F.col(of) / F.lag(of, n).over(series()) - 1


def returns(bars: DataFrame) -> DataFrame:
    out = bars.withColumns({f"ret_{n}": change(n) for n in (1, 3, 5, 10, 20)})
    out = out.withColumn("momentum_20", F.col("ret_20")).withColumn("log_ret", F.log(F.col("close") / F.lag("close").over(series())))
    return out.withColumn("acceleration", F.col("ret_1") - F.lag("ret_1").over(series()))


def volatility(bars: DataFrame, n: int = 20) -> DataFrame:
    """Sample deviation of log returns; needs returns()."""
    return bars.withColumn("volatility", full(F.stddev_samp("log_ret").over(last(n)), "log_ret", n))


def averages(bars: DataFrame, windows: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    out = bars.withColumns({f"sma_{n}": full(F.avg("close").over(last(n)), "close", n) for n in windows})
    return out.withColumns({f"dist_sma_{n}": F.col("close") / F.col(f"sma_{n}") - 1 for n in windows})


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    mean, dev = F.avg("close").over(last(n)), F.stddev_samp("close").over(last(n))
    low, high = mean - width * dev, mean + width * dev
    return bars.withColumn("bb_position", full((F.col("close") - low) / F.nullif(high - low, F.lit(0.0)), "close", n))


def volume_ratio(bars: DataFrame, n: int = 20) -> DataFrame:
    """Volume over the mean of the n bars before."""
    before = series().rowsBetween(-n, -1)
    return bars.withColumn("volume_ratio", F.when(F.count("volume").over(before) == n, F.col("volume") / F.nullif(F.avg("volume").over(before), F.lit(0.0))))


def vwap_deviation(bars: DataFrame, n: int = 20) -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    vwap = F.sum(typical * F.col("volume")).over(last(n)) / F.nullif(F.sum("volume").over(last(n)), F.lit(0.0))
    return bars.withColumn("vwap_dev", full(F.col("close") / vwap - 1, "volume", n))


def gap(bars: DataFrame) -> DataFrame:
    return bars.withColumn("gap", F.col("open") / F.lag("close").over(series()) - 1)


def streaks(bars: DataFrame) -> DataFrame:
    """Runs of lower and of higher closes; null on a symbol's first bar."""
    out = bars.withColumn("_step", F.signum(F.col("close") - F.lag("close").over(series())))
    for name, sign in (("down_streak", -1), ("up_streak", 1)):
        hit = F.coalesce(F.col("_step") == sign, F.lit(False))
        out = out.withColumn("_run", F.sum((~hit).cast("int")).over(series().rowsBetween(W.unboundedPreceding, 0)))
        run = W.partitionBy("symbol", "_run").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumn(name, F.when(F.col("_step").isNotNull(), F.sum(hit.cast("long")).over(run)))
    return out.drop("_step", "_run")


def drawdown(bars: DataFrame, n: int = 252) -> DataFrame:
    return bars.withColumn("drawdown", F.col("close") / F.max("close").over(last(n)) - 1)


def trend_strength(bars: DataFrame, n: int = 50) -> DataFrame:
    """t-statistic of the slope of log price over n bars; 0 where the fit leaves nothing."""
    out = bars.withColumn("_i", F.row_number().over(series()).cast("double")).withColumn("_y", F.log("close"))
    sxx, sxy, syy = (f.over(last(n)) for f in (F.regr_sxx("_y", "_i"), F.regr_sxy("_y", "_i"), F.regr_syy("_y", "_i")))
    slope, rest = sxy / sxx, F.greatest(syy - sxy * sxy / sxx, F.lit(0.0))
    error = F.sqrt(rest / (n - 2) / sxx)
    return out.withColumn("trend_strength", full(F.when(error > 0, slope / error).otherwise(0.0), "_y", n)).drop("_i", "_y")


def extremes(bars: DataFrame) -> DataFrame:
    out = bars.withColumns({"high_20": full(F.max("high").over(last(20)), "high", 20), "low_20": full(F.min("low").over(last(20)), "low", 20)})
    out = out.withColumns({"prev_high_20": F.lag("high_20").over(series()), "prev_low_20": F.lag("low_20").over(series())})
    return out.withColumn("dist_high_252", full(F.col("close") / F.max("high").over(last(252)) - 1, "high", 252))


def flow(bars: DataFrame, windows: tuple[int, ...] = (5, 15)) -> DataFrame:
    signed = 2 * F.col("taker_buy_volume") - F.col("volume")
    return bars.withColumns({f"flow_imbalance_{n}": full(F.sum(signed).over(last(n)) / F.nullif(F.sum("volume").over(last(n)), F.lit(0.0)), "volume", n) for n in windows})


def candles(bars: DataFrame) -> DataFrame:
    """Geometry, and five patterns as 0 or 1."""
    out = bars.withColumns(candle_shape())
    o, c = F.col("open"), F.col("close")
    po, pc = F.lag("open").over(series()), F.lag("close").over(series())
    # Shadows of a hammer or shooting star: one at least twice the body, the other at most 0.3 of it (of a tenth of the range without a body).
    span = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    body, up, down = F.abs(c - o), F.col("high") - F.greatest(o, c), F.least(o, c) - F.col("low")
    short, tall = 0.3 * F.when(body > 0, body).otherwise(span * 0.1), body / span > 0.05
    found = {
        "pat_bullish_engulfing": (pc < po) & (c > o) & (o <= pc) & (c >= po), "pat_bearish_engulfing": (pc > po) & (c < o) & (o >= pc) & (c <= po),
        "pat_hammer": (down >= 2 * body) & (up <= short) & tall, "pat_shooting_star": (up >= 2 * body) & (down <= short) & tall, "pat_doji": body / span < 0.1,
    }
    return out.withColumns({name: F.coalesce(test, F.lit(False)).cast("int") for name, test in found.items()})


def true_range(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(series())
    return bars.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def _changes(bars: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Bars with true ranges, written once since smoothing reads its rows twice; rises and falls of the close."""
    out = true_range(bars).withColumn("_d", F.col("close") - F.lag("close").over(series()))
    up, down = F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0))), F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0)))
    return settled(out, "ranges"), up, down


def _rsi(gain: str, loss: str) -> Column:
    g, k = F.col(gain), F.col(loss)
    return F.when(k > 0, 100 - 100 / (1 + g / F.nullif(k, F.lit(0.0)))).when(g > 0, 100.0).when(g.isNotNull(), 50.0)


def range_and_strength(bars: DataFrame) -> DataFrame:
    """Average true range and the 14-bar RSI only."""
    out, up, down = _changes(bars)
    out = smooth(out, {"atr": ("true_range", 1 / 14, 14), "_gain_14": (up, 1 / 14, 14), "_loss_14": (down, 1 / 14, 14)})
    return out.withColumn("rsi", _rsi("_gain_14", "_loss_14")).drop("_d", "_gain_14", "_loss_14")


def smoothed(bars: DataFrame) -> DataFrame:
    """Exponential averages, average true range, both RSIs and MACD."""
    out, up, down = _changes(bars)
    inputs = {f"ema_{n}": ("close", 2 / (n + 1), n) for n in (20, 50, 200)} | {"atr": ("true_range", 1 / 14, 14), "_fast": ("close", 2 / 13, 12), "_slow": ("close", 2 / 27, 26)}
    inputs |= {f"_{side}_{n}": (x, 1 / n, n) for n in (14, 2) for side, x in (("gain", up), ("loss", down))}
    out = smooth(out, inputs)
    out = out.withColumns({"rsi": _rsi("_gain_14", "_loss_14"), "rsi_2": _rsi("_gain_2", "_loss_2"), "atr_pct": F.col("atr") / F.col("close"), "macd": F.col("_fast") - F.col("_slow")})
    out = out.withColumns({f"dist_ema_{n}": F.col("close") / F.col(f"ema_{n}") - 1 for n in (20, 50, 200)})
    out = smooth(settled(out, "smoothed"), {"macd_signal": ("macd", 0.2, 9)}).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    return out.drop("_d", "_fast", "_slow", "_gain_14", "_loss_14", "_gain_2", "_loss_2")


def regime(bars: DataFrame) -> DataFrame:
    """Trend from the distance to the 200-bar average and its slope; volatility tercile of its rank in 252 bars."""
    slope = F.col("sma_200") / F.lag("sma_200", 20).over(series()) - 1
    away = F.col("close") / F.col("sma_200") - 1
    trend = F.when(slope.isNull(), None).when((away > 0.02) & (slope > 0), "bull").when((away < -0.02) & (slope < 0), "bear").otherwise("sideways")
    seen = F.collect_list("volatility").over(last(252))
    less, same = F.size(F.filter("_seen", lambda v: v < F.col("volatility"))), F.size(F.filter("_seen", lambda v: v == F.col("volatility")))
    out = bars.withColumn("_seen", seen).withColumn("_rank", F.when(F.col("volatility").isNotNull() & (F.size("_seen") >= 60), (less + (same + 1) / 2) / F.size("_seen")))
    level = F.when(F.col("_rank") < 1 / 3, "low_vol").when(F.col("_rank") < 2 / 3, "medium_vol").when(F.col("_rank").isNotNull(), "high_vol")
    return out.withColumns({"trend": trend, "vol_rank": F.col("_rank"), "vol_regime": level}).withColumn("regime", F.concat_ws("/", F.when(level.isNotNull(), F.col("trend")), F.when(F.col("trend").isNotNull(), F.col("vol_regime")))).drop("_seen", "_rank")


def cross_section(bars: DataFrame) -> DataFrame:
    """Ranks, relative strength and breadth (share above the own ema_50) across symbols, as of the panel's previous timestamp."""
    out = bars if "ema_50" in bars.columns else smooth(bars, {"ema_50": ("close", 2 / 51, 50)})
    at = W.partitionBy("ts")
    for n in (5, 20, 60):
        out = out.withColumn(f"_r{n}", change(n))
        rank, ties = F.rank().over(at.orderBy(F.col(f"_r{n}").asc_nulls_last())), F.count("*").over(W.partitionBy("ts", f"_r{n}"))
        out = out.withColumn(f"_xs_rank_ret_{n}", F.when(F.col(f"_r{n}").isNotNull(), (rank + (ties - 1) / 2) / F.count(f"_r{n}").over(at)))
    # Read three times below.
    out = settled(out.withColumn("_rel", F.col("_r20") - F.median("_r20").over(at)), "ranks")
    panel = out.groupBy("ts").agg(F.count("*").alias("xs_n"), F.avg(F.when(F.col("ema_50").isNotNull(), (F.col("close") > F.col("ema_50")).cast("double"))).alias("xs_breadth"))
    # A row a timestamp, whatever the number of symbols: one ordered pass (a single task) finds the timestamp before.
    step = panel.select("ts", F.lag("ts").over(W.partitionBy(F.lit(0)).orderBy("ts")).alias("before"))
    before = panel.select(F.col("ts").alias("before"), "xs_n", "xs_breadth")
    own = out.select("symbol", F.col("ts").alias("before"), *(F.col(f"_xs_rank_ret_{n}").alias(f"xs_rank_ret_{n}") for n in (5, 20, 60)), F.col("_rel").alias("xs_rel_ret_20"))
    return bars.join(step, "ts", "left").join(before, "before", "left").join(own, ["symbol", "before"], "left").drop("before")


def all_features(bars: DataFrame) -> DataFrame:
    out = bars
    for step in (returns, volatility, averages, bollinger, volume_ratio, vwap_deviation, gap, streaks, drawdown, trend_strength, extremes, flow, candles, smoothed, regime):
        out = step(out)
    return settled(out, "features")
