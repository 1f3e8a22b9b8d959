"""Keyed streams against their batch twins, over any cut into micro-batches, restarts, late rows and seeds."""

import datetime as dt
import itertools
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlab.operators import bars, ticks
from marketlab.streaming import stateful

T0 = dt.datetime(2024, 1, 1)
_n = itertools.count()


def run(spark, tmp_path, parts, make, schema, restart_after=None):
    """The stream over one file a part, in order; with restart_after, stopped after so many files and started again."""
    base = tmp_path / f"s{next(_n)}"
    os.makedirs(base / "in")

    def land(some):
        for i, rows in some:
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(base / "stage" / str(i)))
            (found,) = [f for f in os.listdir(base / "stage" / str(i)) if f.endswith(".parquet")]
            os.rename(base / "stage" / str(i) / found, base / "in" / f"{i:04d}.parquet")
            os.utime(base / "in" / f"{i:04d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))

    def drain():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(base / "in"))
        out = make(source)
        out.writeStream.format("parquet").option("checkpointLocation", str(base / "state")).trigger(availableNow=True).start(str(base / "out")).awaitTermination()
        return spark.read.schema(out.schema).parquet(str(base / "out"))

    numbered = list(enumerate(p for p in parts if p))
    if restart_after:
        land(numbered[:restart_after])
        drain()
        land(numbered[restart_after:])
    else:
        land(numbered)
    return drain()


def cut(rows, *at):
    edges = [0, *at, len(rows)]
    return [rows[a:b] for a, b in zip(edges, edges[1:])]


def same(got, want):
    key = lambda r: [repr(v) for v in r if not isinstance(v, float)]
    got, want = sorted(map(tuple, got), key=key), sorted(map(tuple, want), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert [v for v in g if not isinstance(v, float)] == [v for v in w if not isinstance(v, float)]
        assert [v for v in g if isinstance(v, float)] == pytest.approx([v for v in w if isinstance(v, float)], rel=1e-9, abs=1e-9)


def tick_rows(n=160, symbols="AB", seed=1):
    r = np.random.default_rng(seed)
    out, at = [], 0.0
    for i in range(n):
        at += float(r.choice([0.2, 0.7, 3.0, 11.0, 700.0], p=[0.4, 0.3, 0.2, 0.08, 0.02]))
        ts, s = T0 + dt.timedelta(milliseconds=int(1000 * at)), symbols[int(r.integers(len(symbols)))]
        if r.random() < 0.5:
            bid = round(float(r.uniform(90, 110)), 2)
            out.append((s, ts, i, False, bid * (0.0 if r.random() < 0.05 else 1.0), bid + float(r.choice([0.1, 0.0, -0.1], p=[0.8, 0.1, 0.1])), float(r.integers(0, 3)), 1.0, None, None))
        else:
            out.append((s, ts, i, True, None, None, None, None, float(r.integers(1, 9)), bool(r.random() < 0.5)))
    return out


TICKS = "symbol string, ts timestamp, seq long, is_trade boolean, bid double, ask double, bid_qty double, ask_qty double, qty double, buyer_is_maker boolean"
BARS = ("symbol", "ts", "open", "high", "low", "close", "volume", "buy_volume", "sell_volume", "n_trades", "last_bid", "last_ask", "bid_qty", "ask_qty", "outages")


def batch_bars(spark, rows, seconds=5, most=120):
    t = spark.createDataFrame(rows, TICKS)
    found = bars.fill_quiet(bars.tick_bars(t.where("not is_trade"), t.where("is_trade"), f"{seconds} seconds"), seconds, most)
    last = {r["symbol"]: r["m"] for r in found.groupBy("symbol").agg(F.max("ts").alias("m")).collect()}
    return [r for r in found.select(*BARS).collect() if r["ts"] < last[r["symbol"]]]


def test_tick_bars_fill_quiet_intervals_and_skip_outages(spark):
    rows = tick_rows()
    want = batch_bars(spark, rows)
    assert {r["outages"] for r in want} >= {0, 1} and any(r["volume"] == 0 for r in want) and any(r["open"] == r["close"] and r["n_trades"] for r in want)


@pytest.mark.parametrize("at, restart", [((), None), ((1, 2, 3, 50, 51, 90), None), ((40, 80, 120), 2)])
def test_streamed_tick_bars_equal_the_batch(spark, tmp_path, at, restart):
    rows = tick_rows()
    got = run(spark, tmp_path, cut(rows, *at), lambda s: stateful.tick_bars(s, 5), TICKS, restart)
    same(got.select(*BARS).collect(), batch_bars(spark, rows))
    assert {r["late"] for r in got.collect()} == {0}


def test_late_ticks_are_left_out_and_counted(spark, tmp_path):
    quote = lambda second, seq, bid: ("A", T0 + dt.timedelta(seconds=second), seq, False, bid, bid, 1.0, 1.0, None, None)
    got = run(spark, tmp_path, [[quote(0, 1, 10.0), quote(6, 2, 11.0)], [quote(1, 3, 99.0), quote(2, 4, 99.0), quote(12, 5, 12.0)], [quote(3, 6, 99.0), quote(16, 7, 13.0)]], lambda s: stateful.tick_bars(s, 5), TICKS)
    assert [(r["close"], r["late"]) for r in got.orderBy("ts").collect()] == [(10.0, 0), (11.0, 2), (12.0, 3)]


OHLC = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, taker_buy_volume double"


def fine_rows():
    r = np.random.default_rng(3)
    out = []
    for i in sorted(r.choice(60, 45, replace=False).tolist()):
        for s in "AB":
            p = sorted(r.uniform(90, 110, 4).tolist())
            out.append((s, T0 + dt.timedelta(minutes=i), p[1], p[3], p[0], p[2], float(r.integers(1, 9)), 1.0))
    return out


@pytest.mark.parametrize("at", [(), (5, 6, 31, 60)])
def test_coarser_bars_equal_the_batch(spark, tmp_path, at):
    rows = fine_rows()
    got = run(spark, tmp_path, cut(rows, *at), lambda s: stateful.coarser_bars(s, 300, 60), OHLC)
    fine = spark.createDataFrame(rows, OHLC)
    end = max(r[1] for r in rows) + dt.timedelta(minutes=1)
    want = [r for r in bars.resample_bars(fine, "5 minutes").select(*got.columns[:-1]).collect()]
    last = max(r["ts"] for r in want)
    same([tuple(r)[:-1] for r in got.collect()], [r for r in want if r["ts"] < last or end >= r["ts"] + dt.timedelta(minutes=5)])


def test_coarser_bars_end_on_their_boundary_or_with_a_later_bar(spark, tmp_path):
    bar = lambda m, c: ("A", T0 + dt.timedelta(minutes=m), c, c, c, c, 1.0, 0.0)
    got = run(spark, tmp_path, [[bar(0, 1.0), bar(4, 2.0)], [bar(1, 9.0), bar(6, 3.0)], [bar(12, 4.0)]], lambda s: stateful.coarser_bars(s, 300, 60), OHLC)
    # The first is final with minute 4, the second with minute 12; minute 1 came late.
    assert [(r["open"], r["close"], r["volume"], r["late"]) for r in got.orderBy("ts").collect()] == [(1.0, 2.0, 2.0, 0), (3.0, 3.0, 1.0, 1)]


FEATURE_BARS = "symbol string, ts timestamp, close double, high double, volume double, buy_volume double, sell_volume double, last_bid double, last_ask double, bid_qty double, ask_qty double"
SPANS = dict(fast=3, slow=6, vol=8, zscore=7, flow=4, momentum=5, breakout=6, volume=20)
NAMES = ("symbol", "ts", "close", "ema_fast", "ema_slow", "sigma", "rolling_mean", "zscore", "momentum", "prior_high", "breakout", "order_flow_imbalance", "book_imbalance", "spread_pct", "volume_per_second", "bars_seen", "ready")


def feature_bars(n=50):
    r = np.random.default_rng(5)
    out = []
    for i in range(n):
        for s in "ABC"[: 3 if i > 10 else 2]:
            c = 100.0 if 20 <= i < 32 else float(np.round(r.uniform(90, 110), 2))
            v = 0.0 if 20 <= i < 26 else float(r.integers(1, 20))
            out.append((s, T0 + dt.timedelta(seconds=5 * i), c, c + 1, v, v * 0.25, v * 0.75, c - 0.1 if i % 9 else 0.0, c + 0.1 if i % 9 else 0.0, float(i % 4), float(i % 3)))
    return out


def batch_features(spark, rows):
    return ticks.stream_features(spark.createDataFrame(rows, FEATURE_BARS), 5.0, **SPANS).select(*NAMES).collect()


@pytest.mark.parametrize("at, restart", [((), None), ((1, 2, 7, 60, 61), None), ((30, 90), 1)])
def test_streamed_features_equal_the_batch(spark, tmp_path, at, restart):
    rows = feature_bars()
    got = run(spark, tmp_path, cut(rows, *at), lambda s: stateful.stream_features(s, 5.0, **SPANS), FEATURE_BARS, restart)
    same(got.select(*NAMES).collect(), batch_features(spark, rows))
    assert any(r["ready"] for r in got.collect()) and any(r["zscore"] == 0 and r["bars_seen"] > 27 for r in got.collect())


def test_seeded_features_need_no_warm_up_and_have_no_row_for_seeded_bars(spark, tmp_path):
    rows = feature_bars()
    begin = T0 + dt.timedelta(seconds=5 * 25)
    history, later = [r for r in rows if r[1] < begin], [r for r in rows if r[1] >= begin]
    seed = stateful.seed_state(spark.createDataFrame(history, FEATURE_BARS), 5.0, **SPANS)
    seed.write.parquet(str(tmp_path / "seed"))
    seed = spark.read.parquet(str(tmp_path / "seed"))
    # Seeded bars that come again in the stream are late.
    got = run(spark, tmp_path, [history[-3:] + later[:20], later[20:]], lambda s: stateful.stream_features(s, 5.0, seed, **SPANS), FEATURE_BARS)
    same(got.select(*NAMES).collect(), [r for r in batch_features(spark, rows) if r["ts"] >= begin])
    assert got.where("ready").count() > 0 and {r["late"] for r in got.collect()} == {1}


def test_features_known_values(spark):
    rows = [("A", T0 + dt.timedelta(seconds=5 * i), c, c, 10.0, 6.0, 4.0, c, c, 3.0, 1.0) for i, c in enumerate((10.0, 11.0, 12.0))]
    got = ticks.stream_features(spark.createDataFrame(rows, FEATURE_BARS), 5.0, **SPANS).orderBy("ts").collect()
    assert got[0]["ema_fast"] == 10 and got[1]["ema_fast"] == 10.5 and got[2]["prior_high"] == 11 and got[0]["prior_high"] == 10
    assert [round(r["sigma"], 9) for r in got[:2]] == [0.0, round(float(np.log(1.1)), 9)]
    assert got[2]["order_flow_imbalance"] == pytest.approx(0.2) and got[2]["book_imbalance"] == 0.5 and got[2]["volume_per_second"] == 2.0 and not got[2]["ready"]
    none = ticks.stream_features(spark.createDataFrame([("A", T0, 10.0, 10.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], FEATURE_BARS), 5.0).first()
    assert none["spread_pct"] == float("inf") and none["book_imbalance"] == 0 and none["order_flow_imbalance"] == 0


ORDERS = "symbol string, ts timestamp, seq long, bid double, ask double, strategy string, stop_pct double, target_pct double, hold_s long"


def order_rows(n=140):
    r = np.random.default_rng(8)
    out = []
    for i in range(n):
        ts = T0 + dt.timedelta(milliseconds=400 * (i // 2))
        s = "AB"[i % 2]
        p = float(np.round(r.uniform(95, 105), 2))
        out.append((s, ts, i, p - 0.1, p + 0.1, None, None, None, None))
        if r.random() < 0.4:
            out.append((s, ts, (1 << 63) - 1, None, None, str(r.choice(["x", "y"])), float(r.choice([0.02, 0.08])), float(r.choice([0.01, 0.08])), int(r.choice([1, 3, 1000]))))
    return out


@pytest.mark.parametrize("at, restart", [((), None), (tuple(range(7, 160, 9)), None), ((60, 100), 2)])
def test_streamed_shadow_trades_equal_the_batch(spark, tmp_path, at, restart):
    rows = order_rows()
    got = run(spark, tmp_path, cut(rows, *[a for a in at if a < len(rows)]), lambda s: stateful.shadow_trades(s, 0.5, 0.001), ORDERS, restart)
    t = spark.createDataFrame(rows, ORDERS)
    want = ticks.shadow_trades(t.where("strategy is not null").select("strategy", "symbol", "ts", "stop_pct", "target_pct", "hold_s"), t.where("strategy is null").select("symbol", "ts", "seq", "bid", "ask"), 0.5, 0.001)
    columns = ("symbol", "strategy", "signal_ts", "entry_ts", "entry_price", "exit_ts", "exit_price", "reason", "net_return")
    want = want.select(*columns).collect()
    same(got.select(*columns).collect(), want)
    assert {r["reason"] for r in want} == {"stop", "target", "time"} and len({r["strategy"] for r in want}) == 2


def test_an_open_trade_keeps_later_signals_out(spark):
    q = spark.createDataFrame([("A", T0 + dt.timedelta(seconds=i), i, p, p) for i, p in enumerate([100.0, 100.0, 100.0, 90.0, 90.0])], "symbol string, ts timestamp, seq long, bid double, ask double")
    s = spark.createDataFrame([("x", "A", T0, 0.5, 0.5, 10**9), ("x", "A", T0 + dt.timedelta(seconds=1), 0.05, 0.5, 10), ("y", "A", T0 + dt.timedelta(seconds=1), 0.05, 0.5, 10)], "strategy string, symbol string, ts timestamp, stop_pct double, target_pct double, hold_s int")
    assert [r["strategy"] for r in ticks.shadow_trades(s, q, 0.0).collect()] == ["y"]


@pytest.mark.parametrize("at", [(), (1, 7, 40)])
def test_equity_samples(spark, tmp_path, at):
    rng = np.random.default_rng(4)
    rows = [("r", T0 + dt.timedelta(seconds=float(s)), k, float(v), 1.0) for k, (s, v) in enumerate(zip(np.cumsum(rng.choice([0.0, 0.5, 1.0, 4.9, 5.0, 12.0], 60)), rng.normal(100, 5, 60)))]
    want, kept, peak = [], None, -np.inf
    for run_, ts, _, v, b in rows:
        peak = max(peak, v)
        if kept is None or (ts - kept).total_seconds() >= 5:
            kept = ts
            want.append((run_, ts, v, b, peak))
    old = ("r", T0 - dt.timedelta(seconds=9), 99, 1e6, 1.0)
    got = run(spark, tmp_path, [*cut(rows, *at), [old]], stateful.equity_samples, "run_id string, ts timestamp, seq long, equity double, buy_hold double", restart_after=2 if at else None)
    same([tuple(r)[:5] for r in got.collect()], want)


def test_signals_of_a_dense_batch_stay_arrays():
    """What a step holds besides its rows: no object for each signal that an open trade keeps out."""
    import tracemalloc

    n = 50_000
    quotes = pd.DataFrame({"us": [0, 10, n], "seq": [1, 2, 3], "bid": 100.0, "ask": 100.1, "strategy": None, "stop_pct": np.nan, "target_pct": np.nan, "hold_s": np.nan})
    signals = pd.DataFrame({"us": np.arange(n), "seq": (1 << 63) - 1, "bid": np.nan, "ask": np.nan, "strategy": "x", "stop_pct": 0.5, "target_pct": 0.5, "hold_s": 100.0})
    rows = pd.concat([quotes.astype({"strategy": object}), signals]).sort_values(["us", "seq"], kind="stable", ignore_index=True)
    tracemalloc.start()
    out, state = stateful.ShadowTrades(0.0).step(rows, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not len(out) and state["signal_us"] == [0] and peak < 15_000_000


class Kept:
    """A state of one value, without a store."""

    def __init__(self, value=None):
        self.value = value

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def fed(processor, chunks, state):
    """What comes out of a micro-batch that is read chunk by chunk."""
    processor._names, processor._state = [p.strip().split(" ")[0] for p in processor.state_schema.split(",")], state
    return list(processor.handleInputRows(("A",), iter(chunks), None))


@pytest.mark.parametrize("seed", range(6))
def test_tick_bars_do_not_depend_on_the_order_in_which_chunks_are_read(seed):
    r = np.random.default_rng(seed)
    rows = pd.DataFrame(tick_rows(240, "A", seed), columns=[c.split(" ")[0] for c in TICKS.split(", ")])
    rows["us"] = rows.pop("ts").astype("datetime64[us]").astype("int64")
    rows.loc[: 5 * seed, "is_trade"] = True  # trades that wait for the first quote
    rows.loc[rows["is_trade"] & rows["qty"].isna(), ["bid", "ask", "qty", "buyer_is_maker"]] = [None, None, 2.0, True]
    rows[["bid", "ask", "qty"]] = rows[["bid", "ask", "qty"]].astype(float)
    small = lambda: type("Small", (stateful.TickBars,), {"PILE": 7, "STEP": 3})(5)
    whole, pieces = Kept(), Kept()
    for half in (rows.iloc[:150], rows.iloc[140:]):  # ten ticks come twice, most of them late
        want = pd.concat(fed(stateful.TickBars(5), [half], whole))
        chunks = [half.iloc[np.sort(part)] for part in np.array_split(r.permutation(len(half)), 9)]
        got = pd.concat(fed(small(), chunks, pieces), ignore_index=True)
        pd.testing.assert_frame_equal(got, want.reset_index(drop=True), check_dtype=False)
        assert pieces.value == pytest.approx(whole.value)
    assert whole.value[-2] > 0


def test_ticks_of_a_symbol_are_summed_as_they_are_read():
    import tracemalloc

    def chunks():
        for k in range(40):
            us = np.arange(k * 10_000, (k + 1) * 10_000) * 1000
            traded = us // 1000 % 2 == 1
            yield pd.DataFrame({"us": us, "seq": us // 1000, "is_trade": traded, "bid": np.where(traded, np.nan, 10.0), "ask": np.where(traded, np.nan, 10.5), "bid_qty": 1.0, "ask_qty": 1.0, "qty": np.where(traded, 1.0, np.nan), "buyer_is_maker": np.where(traded, us % 3 == 0, None)})

    tracemalloc.start()
    out = fed(stateful.TickBars(60), chunks(), Kept())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    bars_ = pd.concat(out)
    assert len(bars_) == 6 and bars_["n_trades"].eq(30_000).all() and peak < 15_000_000
