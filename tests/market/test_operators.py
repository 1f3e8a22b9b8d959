"""Golden values, causality and a sequential check of trade extraction."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketlab import queries
from marketlab.functions import columns
from marketlab.operators import bars, features, joins, trades, validation
from marketlab.operators.scan import smooth
from marketlab.sources import views


def series(spark, closes, symbol="A"):
    rows = [(symbol, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(c), c + 1.0, c - 1.0, float(c), 1000.0, 500.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, taker_buy_volume double")


def walk(n, seed):
    r, out, x = random.Random(seed), [], 100.0
    for _ in range(n):
        x = max(5.0, x * (1 + r.gauss(0.0005, 0.02)))
        out.append(x)
    return out


def test_streaks(spark):
    got = features.streaks(series(spark, [10, 9, 8, 7, 7, 8, 9, 8.5])).orderBy("ts").collect()
    assert [r["down_streak"] for r in got] == [None, 1, 2, 3, 0, 0, 0, 1] and [r["up_streak"] for r in got] == [None, 0, 0, 0, 0, 1, 2, 0]


@pytest.mark.parametrize("closes, value", [(range(10, 40), 100.0), (range(60, 30, -1), 0.0), ([10] * 30, 50.0)])
def test_rsi_extremes(spark, closes, value):
    assert features.smoothed(series(spark, list(closes))).orderBy(F.desc("ts")).first()["rsi"] == pytest.approx(value)


def test_smoothing_over_blocks_and_nulls(spark):
    x = [None, 3.0, 5.0, None, *walk(60, 1)]
    rows = spark.createDataFrame([("A", i, v) for i, v in enumerate(x)], "symbol string, ts int, v double")
    got = [r["y"] for r in smooth(rows, {"y": ("v", 0.2, 3)}, block=8).orderBy("ts").collect()]
    y, n = None, 0
    for v, g in zip(x, got):
        if v is None:
            assert g is None
            continue
        y, n = v if y is None else 0.8 * y + 0.2 * v, n + 1
        assert (g is None) if n < 3 else g == pytest.approx(y)


def test_features_do_not_look_ahead(spark):
    closes = walk(300, 2)
    keep = ["ts", "sma_50", "rsi", "atr", "trend_strength", "vol_regime", "down_streak", "flow_imbalance_5"]
    whole = features.all_features(series(spark, closes)).select(*keep).orderBy("ts").limit(260).collect()
    assert features.all_features(series(spark, closes[:260])).select(*keep).orderBy("ts").collect() == whole


def test_wilson(spark):
    low, high = columns.wilson(F.col("w"), F.col("n"))
    got = spark.createDataFrame([(95, 100), (0, 0)], "w long, n long").select(low, high).collect()
    assert tuple(got[0]) == pytest.approx((0.8882, 0.9785), abs=1e-4) and tuple(got[1]) == (0.0, 1.0)


def test_false_discovery(spark):
    p = spark.createDataFrame([(x,) for x in (0.01, 0.04, 0.03, 0.005, 0.5)], "p double")
    got = {r["p"]: (r["p_adjusted"], r["rejected"]) for r in validation.benjamini_hochberg(p).collect()}
    assert [got[x][1] for x in (0.01, 0.04, 0.03, 0.005, 0.5)] == [True, True, True, True, False] and got[0.005][0] == pytest.approx(0.025)


def test_metrics(spark):
    r = trades.metrics(spark.createDataFrame([(x,) for x in (0.02, -0.01, 0.03, -0.01)], "net_return double")).first()
    assert [r[k] for k in ("n", "win_rate", "avg_win", "avg_loss", "ev", "profit_factor")] == pytest.approx([4, 0.5, 0.025, 0.01, 0.0075, 2.5])


def test_trades_match_a_sequential_loop(spark):
    closes = walk(200, 5)
    b = series(spark, closes).withColumn("atr", F.lit(2.0)).withColumn("go_flag", F.col("close") > 1.01 * F.avg("close").over(features.last(5))).withColumn("out_flag", F.col("close") < F.lag("close").over(features.series()) * 0.985)
    variants = spark.createDataFrame([("a", 2.0, 3.0, 10), ("b", 1.0, None, 4)], "variant string, stop_atr double, target_atr double, hold int")
    found = trades.single_position(trades.candidates(b, variants, F.col("go_flag"), F.col("out_flag")))
    got = {v: sorted((r["entry_i"], r["exit_i"], r["reason"], round(r["exit_price"], 9)) for r in found.collect() if r["variant"] == v) for v in "ab"}
    rows = [None, *b.orderBy("ts").collect()]
    for v, stop_k, target_k, hold in (("a", 2.0, 3.0, 10), ("b", 1.0, None, 4)):
        want, free = [], 0
        for e in range(2, len(rows)):
            if not rows[e - 1]["go_flag"] or e <= free:
                continue
            stop, target = rows[e]["open"] - stop_k * 2, rows[e]["open"] + (target_k or 1e9) * 2
            for i in range(e, len(rows)):
                r = rows[i]
                if i > e and rows[i - 1]["out_flag"]:
                    end = ("signal", r["open"])
                elif i - e >= hold:
                    end = ("max_holding", r["open"])
                elif r["low"] <= stop:
                    end = ("stop", stop if i == e else min(r["open"], stop))
                elif r["high"] >= target:
                    end = ("target", target if i == e else max(r["open"], target))
                elif i == len(rows) - 1:
                    end = ("end_of_data", r["close"])
                else:
                    continue
                want.append((e, i, end[0], round(end[1], 9)))
                free = i
                break
        assert got[v] == want and len(want) > 3


def test_quiet_bars_and_reconciliation(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("A", t, 1.0, 1.0, 1.0, 5.0, 1.0), ("A", t + dt.timedelta(seconds=20), 6.0, 6.0, 6.0, 6.0, 1.0), ("A", t + dt.timedelta(seconds=2000), 7.0, 7.0, 7.0, 7.0, 1.0)]
    got = bars.fill_quiet(spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double"), 5).orderBy("ts").collect()
    assert [r["close"] for r in got] == [5, 5, 5, 5, 6, 7] and sum(r["volume"] for r in got) == 3
    book = lambda *r: spark.createDataFrame(r, "symbol string, quantity double")
    assert {r["symbol"] for r in joins.reconcile(book(("A", 1.0), ("B", 2.0), ("C", 1.0)), book(("A", 1.0 + 1e-12), ("B", 2.1), ("D", 1.0))).collect()} == {"B", "C", "D"}


def test_asof_queries_answer_every_trade(spark, tmp_path):
    r = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    seconds = r.sample(range(1200), 60)
    rows = [(i, r.choice("ab"), start + dt.timedelta(seconds=s), float(r.randrange(100)), None) for i, s in enumerate(seconds)]
    spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    ask = {x["seq"]: x["ask"] for x in queries.jn1_forward_asof(spark, str(tmp_path)).collect()}
    bid = {x["seq"]: x["bid"] for x in queries.jn2_backward_asof(spark, str(tmp_path)).collect()}
    assert len(ask) == len(bid) == len(rows)
    for i, symbol, ts, _, _ in rows:
        after = min(((t, v) for _, s, t, v, _ in rows if s == symbol and t >= ts + dt.timedelta(seconds=60)), default=None)
        before = max(((t, v) for _, s, t, v, _ in rows if s == symbol and t <= ts - dt.timedelta(seconds=1)), default=None)
        assert ask[i] == (after and pytest.approx((after[1] + 1) * 1.0005)) and bid[i] == (before and pytest.approx((before[1] + 1) * 0.9995))


def test_headlines_keep_the_whole_text(spark, tmp_path):
    text = "word " * 50 + "bankruptcy"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1))], "event_id long, event_type string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    assert views.headlines(spark, str(tmp_path)).first()["headline"] == text
