"""Tick-level work: aggressor signs, bulk volume, the stream's feature set, its two strategies, and shadow trades on quotes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marketlab.functions.columns import normal_cdf
from marketlab.operators.joins import asof
from marketlab.operators.scan import smooth


def signed_trades(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Adds ``side`` (1 buy, -1 sell): at or above the last ask, at or below the last bid, else the tick, else the side before, else against the mid."""
    known = asof(trades, quotes.withColumn("_q", F.struct("bid", "ask")), "_q")
    w = W.partitionBy("symbol").orderBy("ts", "seq")
    tick = F.signum(F.col("price") - F.lag("price").over(w)).cast("int")
    sure = F.when(F.col("price") >= F.col("_q.ask"), 1).when(F.col("price") <= F.col("_q.bid"), -1).when(tick != 0, tick)
    carried = F.last("_sure", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    mid = (F.col("_q.bid") + F.col("_q.ask")) / 2
    return known.withColumn("_sure", sure).withColumn("side", F.coalesce(carried, F.when(F.col("price") >= mid, 1).otherwise(-1))).drop("_q", "_sure")


def bulk_volume(bars: DataFrame, n: int = 50, least: int = 10) -> DataFrame:
    """Adds ``taker_buy_volume``: volume times the normal probability of the bar's return over its recent spread; one half where unknown."""
    w = W.partitionBy("symbol").orderBy("ts")
    rows = bars.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1)
    frame = w.rowsBetween(-(n - 1), 0)
    sd = F.when(F.count("_r").over(frame) >= least, F.stddev_samp("_r").over(frame))
    z = F.col("_r") / F.nullif(sd, F.lit(0.0))
    z = F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-10.0)), F.lit(10.0)))
    return rows.withColumn("taker_buy_volume", F.col("volume") * F.coalesce(normal_cdf(z), F.lit(0.5))).drop("_r")


def stream_features(bars: DataFrame, interval_s: float, fast: int = 12, slow: int = 48, vol: int = 60, zscore: int = 60, flow: int = 12, momentum: int = 12, breakout: int = 24, volume: int = 720) -> DataFrame:
    """The feature set of the event stream, in batch: bars carry volume, buy_volume, sell_volume and the last book; a bar is ready after the longest span but the volume's."""
    warmup = max(slow, vol, zscore, breakout) + 1
    w = W.partitionBy("symbol").orderBy("ts")
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    before = F.lag("close").over(w)
    rows = bars.withColumn("_r2", F.when(before > 0, F.pow(F.log(F.col("close") / before), 2)))
    rows = smooth(rows, {"ema_fast": ("close", 2 / (fast + 1), 1), "ema_slow": ("close", 2 / (slow + 1), 1), "_var": ("_r2", 2 / (vol + 1), 1)})
    w_var = F.last("_var", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    mean = F.avg("close").over(last(zscore))
    # Equal closes have no spread, whatever their average is rounded to.
    spread = F.when(F.max("close").over(last(zscore)) > F.min("close").over(last(zscore)), F.stddev_pop("close").over(last(zscore))).otherwise(0.0)
    prior = F.coalesce(F.max("high").over(w.rowsBetween(-breakout, -1)), F.col("close"))
    total = F.sum("volume").over(last(flow))
    depth, mid = F.col("bid_qty") + F.col("ask_qty"), (F.col("last_bid") + F.col("last_ask")) / 2
    zero = F.lit(0.0)
    rows = rows.withColumns({"_v": w_var, "_n": F.row_number().over(w)})
    return rows.withColumns({
        "sigma": F.sqrt(F.coalesce("_v", zero)), "rolling_mean": mean, "zscore": F.when(spread > 0, (F.col("close") - mean) / F.nullif(spread, zero)).otherwise(0.0), "momentum": F.coalesce(F.col("close") / F.lag("close", momentum).over(w) - 1, zero),
        "prior_high": prior, "breakout": (F.col("_n") > breakout) & (F.col("close") > prior), "order_flow_imbalance": F.when(total > 0, F.sum(F.col("buy_volume") - F.col("sell_volume")).over(last(flow)) / F.nullif(total, zero)).otherwise(0.0),
        "book_imbalance": F.when(depth > 0, (F.col("bid_qty") - F.col("ask_qty")) / F.nullif(depth, zero)).otherwise(0.0), "spread_pct": F.when(mid > 0, (F.col("last_ask") - F.col("last_bid")) / F.nullif(mid, zero)).otherwise(float("inf")), "bars_seen": F.col("_n").cast("long"),
        "volume_per_second": F.sum("volume").over(last(volume)) / (F.count("*").over(last(volume)) * interval_s), "ready": (F.col("_n") >= warmup) & F.coalesce(F.col("_v") > 0, F.lit(False)),
    }).drop("_r2", "_var", "_v", "_n")


def windows_of(horizon: Column) -> dict[str, Column]:
    """Feature windows in proportion to a holding horizon in bars."""
    at_least = lambda n, x: F.greatest(F.lit(n), F.floor(x)).cast("int")
    return {"fast": at_least(3, horizon / 4), "slow": at_least(6, horizon), "vol": at_least(60, horizon), "zscore": at_least(20, horizon), "flow": at_least(6, horizon / 4), "momentum": at_least(2, horizon / 4), "breakout": at_least(4, horizon / 2)}


#: The five hypotheses of the stream: name, kind, minutes, breakout needed, z of the entry (fixed values).
HYPOTHESES = (("momentum_1m", "momentum", 1.0, True, None), ("momentum_5m", "momentum", 5.0, True, None), ("momentum_20m", "momentum", 20.0, False, None), ("reversion_2z_2m", "reversion", 2.0, None, 2.0), ("reversion_3z_10m", "reversion", 10.0, None, 3.0))


def _stop(mult: float, scale: Column) -> Column:
    return F.least(F.greatest(mult * scale, F.lit(0.0015)), F.lit(0.02))


def momentum_intents(features: DataFrame, horizon: int = 24, ofi_min: float = 0.25, breakout: bool = True) -> DataFrame:
    """Entries of the order-flow momentum strategy with stop and target as fractions; ``exit`` marks bars where holders leave."""
    c, scale = F.col, F.col("sigma") * F.sqrt(F.lit(float(horizon)))
    enter = c("ready") & (c("ema_fast") > c("ema_slow")) & (c("momentum") > 0) & (c("order_flow_imbalance") >= ofi_min) & (c("book_imbalance") >= -0.5)
    enter = enter & c("breakout") if breakout else enter
    return features.withColumns({"enter": enter, "stop_pct": _stop(1.5, scale), "target_pct": 2.5 * scale, "hold": F.lit(2 * horizon), "exit": (c("ema_fast") < c("ema_slow")) & (c("order_flow_imbalance") < 0)})


def reversion_intents(features: DataFrame, horizon: int = 24, z_entry: float = 2.0, ofi_floor: float = -0.2) -> DataFrame:
    """Entries of the stretched-dip strategy; its target is the way back to the rolling mean."""
    c, scale = F.col, F.col("sigma") * F.sqrt(F.lit(float(horizon)))
    enter = c("ready") & (c("zscore") <= -z_entry) & (c("order_flow_imbalance") >= ofi_floor) & (c("book_imbalance") >= 0)
    return features.withColumns({"enter": enter, "stop_pct": _stop(2.0, scale), "target_pct": (c("rolling_mean") - c("close")) / c("close"), "hold": F.lit(2 * horizon), "exit": c("zscore") >= 0})


def clears_costs(multiple: float, fee: float, slippage: float) -> Column:
    """Does the target pay several round trips (fees both sides, spread, slippage both ways)?"""
    return F.col("target_pct") >= multiple * (2 * fee + F.col("spread_pct") + 2 * slippage)


def bar_path(bars: DataFrame, seconds: int) -> DataFrame:
    """Four quotes in order for every bar: open, low, high, close when it rose, else open, high, low, close; evenly spaced in the bar."""
    up = F.col("close") >= F.col("open")
    prices = F.array("open", F.when(up, F.col("low")).otherwise(F.col("high")), F.when(up, F.col("high")).otherwise(F.col("low")), "close")
    rows = bars.select("symbol", "ts", F.posexplode(prices).alias("step", "price"))
    return rows.select("symbol", F.timestamp_micros(F.unix_micros("ts") + (F.col("step") * F.lit(seconds * 250_000).cast("long"))).alias("ts"), "step", "price")


#: Microseconds of a time before all others.
NEVER = -(1 << 62)


def advance(t: dict, us: np.ndarray, bid: np.ndarray, ask: np.ndarray, latency: int, before: tuple[int, float] | None = None) -> dict | None:
    """Move an open trade along the quotes, in place; the finished trade, or nothing yet. before: time and bid of the first quote of the last time before these quotes."""
    at = 0
    if t["entry_us"] is None:
        at = int(np.searchsorted(us, t["signal_us"] + latency))
        if at == len(us):
            return None
        t |= {"entry_us": int(us[at]), "entry_price": float(ask[at])}
        at += 1
    if t["exit_from"] is None:
        until = t["entry_us"] + t["hold_us"]
        end = int(np.searchsorted(us, until, "right"))
        stop, target = t["entry_price"] * (1 - t["stop_pct"]), t["entry_price"] * (1 + t["target_pct"])
        step = 64
        while at < end:
            # Most trades end soon: look at a few quotes first, then at ever more.
            part = bid[at : min(end, at + step)]
            hits = np.flatnonzero((part <= stop) | (part >= target))
            if len(hits):
                k = at + int(hits[0])
                t |= {"exit_from": int(us[k]) + latency, "reason": "stop" if bid[k] <= stop else "target"}
                break
            at, step = at + len(part), 4 * step
        else:
            if end == len(us):
                return None
            t |= {"exit_from": until + latency, "reason": "time"}
    if before is not None and before[0] >= t["exit_from"]:
        return t | {"exit_us": before[0], "exit_price": before[1]}
    at = int(np.searchsorted(us, t["exit_from"]))
    return t | {"exit_us": int(us[at]), "exit_price": float(bid[at])} if at < len(us) else None


def one_at_a_time(t: dict | None, busy: int, signals: dict[str, np.ndarray], us: np.ndarray, bid: np.ndarray, ask: np.ndarray, latency: int, before: tuple[int, float] | None = None) -> tuple[dict | None, int, int, list[dict]]:
    """A strategy's trades along the quotes of a symbol: the one still open, when the last one ended, how many signals are decided, and the finished ones.

    signals: signal_us, rising, with stop_pct, target_pct and hold_us. One that comes while a trade is open, or as it ends, is skipped.
    """
    done, at = [], 0
    while True:
        if t is None:
            at = max(at, int(np.searchsorted(signals["signal_us"], busy, "right")))
            if at == len(signals["signal_us"]):
                return None, busy, at, done
            t = {"entry_us": None, "entry_price": None, "exit_from": None, "reason": None, **{n: v[at].item() for n, v in signals.items()}}
            at += 1
        ended = advance(t, us, bid, ask, latency, before)
        if ended is None:
            return t, busy, at, done
        done.append(ended)
        t, busy = None, ended["exit_us"]


def shadow_trades(signals: DataFrame, quotes: DataFrame, latency_s: float = 0.25, fee: float = 0.001) -> DataFrame:
    """Trades of signals on quotes: in at the first ask after the latency, out at the first bid after what ends them.

    signals: strategy, symbol, ts, stop_pct, target_pct, hold_s. A later quote at or below the stop or at or above the target ends a
    trade, and so does ``hold_s``; the fill is the first bid the latency later. A signal is skipped while its strategy and symbol have
    a trade open; a trade without an end is left out. Signals and quotes of a symbol stream by in order of time, each once; a task holds a batch of them
    and each strategy's open trade, however long trades are held and however dense quotes are.
    """
    c, us = F.col, 1_000_000
    latency = int(latency_s * us)
    none = F.lit(None).cast("double")
    # At equal times signals go first: all quotes that may fill one come after it.
    # What differs from quote to quote stands together, before what quotes leave empty and what repeats: so the rows shuffled compress best.
    book = quotes.select(c("seq").cast("long").alias("seq"), c("bid").cast("double").alias("bid"), c("ask").cast("double").alias("ask"), F.unix_micros("ts").alias("us"), none.alias("stop_pct"), none.alias("target_pct"), F.lit(None).cast("long").alias("hold_us"), F.lit(None).cast("string").alias("strategy"), "symbol")
    asked = signals.where("strategy is not null").select(F.lit(NEVER).cast("long").alias("seq"), none.alias("bid"), none.alias("ask"), F.unix_micros("ts").alias("us"), c("stop_pct").cast("double").alias("stop_pct"), c("target_pct").cast("double").alias("target_pct"), (c("hold_s").cast("long") * us).alias("hold_us"), "strategy", "symbol")
    columns = "symbol string, strategy string, signal_us long, entry_us long, entry_price double, exit_us long, exit_price double, reason string"
    names = [p.strip().split(" ")[0] for p in columns.split(",")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.string()]
    numbers = {"signal_us": "us", "stop_pct": "stop_pct", "target_pct": "target_pct", "hold_us": "hold_us"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, open_, busy, waiting, before = None, {}, {}, {}, None
        for batch in batches:
            done: list[dict] = []
            v = {n: batch.column(n).fill_null(0).to_numpy(zero_copy_only=False) for n in ("us", "bid", "ask", "stop_pct", "target_pct", "hold_us")}
            owner, strategy = batch.column("symbol").dictionary_encode(), batch.column("strategy").dictionary_encode()
            codes, code = owner.indices.fill_null(-1).to_numpy(zero_copy_only=False), strategy.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)] if len(codes) else [0]
            for lo, hi in zip(edges, edges[1:]):
                own = owner.dictionary[int(codes[lo])].as_py() if codes[lo] >= 0 else None
                if own != symbol:
                    symbol, open_, busy, waiting, before = own, {}, {}, {}, None
                if own is None:
                    continue
                kind = code[lo:hi]
                quoted = kind < 0
                at, bid, ask = (v[n][lo:hi][quoted] for n in ("us", "bid", "ask"))
                new = {strategy.dictionary[int(k)].as_py(): kind == k for k in np.unique(kind[~quoted])}
                now = int(at[-1]) if len(at) else before[0] if before else NEVER
                for s in {**open_, **new}:
                    queue = {n: v[of][lo:hi][new.get(s, slice(0))] for n, of in numbers.items()}
                    if s in waiting:
                        queue = {n: np.concatenate([waiting[s][n], q]) for n, q in queue.items()}
                    trade, busy[s], decided, ended = one_at_a_time(open_.pop(s, None), busy.get(s, NEVER), queue, at, bid, ask, latency, before)
                    waiting.pop(s, None)
                    if trade:
                        open_[s] = trade
                        # The next quote may show that this trade had ended by now: then the first signal since is due, and keeps out the others before that quote.
                        k = max(decided, int(np.searchsorted(queue["signal_us"], now, "right")))
                        if k < len(queue["signal_us"]):
                            waiting[s] = {n: q[k : k + 1] for n, q in queue.items()}
                    done += [{"symbol": symbol, "strategy": s} | e for e in ended]
                if len(at):
                    first = int(np.searchsorted(at, at[-1]))
                    if first or before is None or before[0] != at[-1]:
                        before = (int(at[first]), float(bid[first]))
            yield pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], k) for n, k in zip(names, kinds)], names=names)

    order = ["symbol", "us", "seq", "strategy", "stop_pct", "target_pct", "hold_us"]
    rows = book.unionByName(asked).repartition("symbol").sortWithinPartitions(*order).select("symbol", "us", "bid", "ask", "strategy", "stop_pct", "target_pct", "hold_us")
    found = rows.mapInArrow(run, columns)
    times = {n: F.timestamp_micros(f"{n[:-3]}_us") for n in ("signal_ts", "entry_ts", "exit_ts")}
    return found.withColumns(times).select("symbol", "strategy", "signal_ts", "entry_ts", "entry_price", "exit_ts", "exit_price", "reason", (c("exit_price") * (1 - fee) / (c("entry_price") * (1 + fee)) - 1).alias("net_return"))


def fill_price(shown: Column, wanted: Column, price: Column, impact: float) -> Column:
    """Volume-weighted price of a buy: what exceeds the shown size pays ``impact`` more."""
    rest = F.greatest(wanted - shown, F.lit(0.0))
    return F.when(wanted > 0, (F.least(shown, wanted) * price + rest * price * (1 + impact)) / F.nullif(wanted, F.lit(0.0)))


def round_trips(fills: DataFrame) -> DataFrame:
    """P&L of positions from their fills: position, side (buy or sell), price, quantity, fee; positions without both sides are open and go."""
    side = lambda s, x: F.sum(F.when(F.col("side") == s, x))
    value = F.col("price") * F.col("quantity")
    rows = fills.groupBy("position").agg(side("buy", value).alias("paid"), side("sell", value).alias("got"), F.sum("fee").alias("fees"), side("buy", F.col("quantity")).alias("quantity"))
    rows = rows.where("paid is not null and got is not null").withColumn("pnl", F.col("got") - F.col("paid") - F.col("fees"))
    return rows.withColumn("net_return", F.col("pnl") / F.nullif("paid", F.lit(0.0)))
