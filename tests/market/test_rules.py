"""The rule catalogue, research figures and streamed bars."""

import datetime as dt

import pytest

from marketlab.operators import research
from marketlab.plans import rules
from marketlab.streaming.bars import drain, stream_bars

DAY = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("chosen, n", [(rules.DAILY, 49), (rules.INTRADAY, 179), (rules.SWING, 118)])
def test_number_of_variants(chosen, n):
    assert sum(len(r.variants()) for r in chosen) == n and len({v for r in chosen for _, v, _ in r.variants()}) == n


def test_base_comes_once():
    by_name = {r.name: [v for _, v, _ in r.variants()] for r in rules.DAILY + rules.SWING}
    assert by_name["momentum"][0] == "momentum" and by_name["breakout"][0] == "breakout[vol_th=1.0,stop_atr=1.5]" and len(by_name["rsi2_reversion"]) == 3


def test_applicable():
    assert {r.name for r in rules.SWING} - {r.name for r in rules.applicable(rules.SWING)} == {"ibs_reversion", "near_52w_high", "turn_of_month", "news_drift", "quiet_drop_reversal", "earnings_gap_drift"}


def test_conditions_and_variant_table(spark):
    chosen = tuple(r for r in rules.DAILY if r.name == "mean_reversion")
    table = rules.variant_table(spark, chosen)
    row = table.where("variant = 'mean_reversion[rsi_th=25,hold=5]'").first()
    assert (row["stop_atr"], row["target_atr"], row["hold"]) == (2.0, None, 5)
    bars = spark.createDataFrame([(1, 20.0, 2.0, 1.0), (2, 28.0, 2.0, 1.0), (3, None, 2.0, 1.0), (4, 20.0, 1.0, None), (5, 60.0, 2.0, 1.0)], "i int, rsi double, close double, ema_200 double")
    enter, leave = rules.conditions(chosen)
    got = bars.crossJoin(table).select("i", "variant", enter.alias("e"), leave.alias("l")).where("variant = 'mean_reversion[rsi_th=25,hold=5]'").orderBy("i").collect()
    assert [r["e"] for r in got] == [True, False, False, False, False] and [r["l"] for r in got] == [False, False, False, False, True]


def test_crosses(spark):
    rows = spark.createDataFrame([("A", DAY + dt.timedelta(days=i), a, 2.0) for i, a in enumerate([1.0, 2.0, 3.0, 2.0, 1.0, None, 3.0])], "symbol string, ts timestamp, a double, b double")
    up, down = rules.crosses("a", "b")
    got = rows.withColumns({"up": up, "down": down}).orderBy("ts").collect()
    assert [r["up"] for r in got] == [False, False, True, False, False, False, False] and [r["down"] for r in got] == [False, False, False, False, True, False, False]


def test_stability_and_date_means(spark):
    s = research.stability(spark.createDataFrame([("m", 0.1), ("m", 0.2), ("m", 0.3), ("m", -0.1)], "rule string, ev double"), "rule").first()
    assert s["fraction_positive"] == 0.75 and s["median_ev"] == pytest.approx(0.15) and s["score"] == pytest.approx(0.75 * 0.5)
    t = spark.createDataFrame([("v", DAY, 0.1), ("v", DAY, 0.3)], "variant string, entry_ts timestamp, net_return double")
    assert research.date_means(t, "variant").first()["net_return"] == pytest.approx(0.2)


def test_monte_carlo(spark):
    t = spark.createDataFrame([("v", DAY + dt.timedelta(days=i), DAY + dt.timedelta(days=i + 1), r) for i, r in enumerate([0.1, -0.05, 0.02])] + [("w", DAY, DAY, -0.5)], "variant string, entry_ts timestamp, exit_ts timestamp, net_return double")
    one, two = (research.monte_carlo(x, "variant", sims=50).orderBy("variant").collect() for x in (t, t.repartition(7)))
    assert one == two and one[1]["p_loss"] == 1.0 and one[1]["final_p50"] == pytest.approx(-0.5) and one[1]["drawdown_p95"] == pytest.approx(-0.5)
    assert one[0]["final_p5"] <= one[0]["final_p50"] <= one[0]["final_p95"]


def test_streamed_bars_wait_for_a_later_trade(spark, tmp_path):
    rows = [("A", DAY + dt.timedelta(seconds=s), p, 1.0, s % 2 == 0, s) for s, p in ((0, 5.0), (1, 7.0), (4, 6.0), (5, 9.0), (11, 8.0))]
    schema = "symbol string, ts timestamp, price double, qty double, buyer_is_maker boolean, seq long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drain(stream_bars(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "5 seconds"), "bars").orderBy("ts").collect()
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in got] == [(5.0, 7.0, 5.0, 6.0, 3.0), (9.0, 9.0, 9.0, 9.0, 1.0)]
