"""Folds, walk-forward choice, study-wide control, resampling, bar series and news features on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlab.operators import feeds, research, study, trades, validation


def day(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=i)


def test_folds(spark):
    bars = spark.createDataFrame([("A", day(i)) for i in range(100)] + [("B", day(0))], "symbol string, ts timestamp")
    got = {(r.symbol, r.fold): (r.lo, r.hi) for r in study.fold_bounds(bars).collect()}
    assert got[("A", "is")] == (0, 70) and got[("A", "oos")] == (70, 100) and got[("A", "train_2")] == (0, 33) and got[("A", "test_5")] == (83, 100)
    assert not [k for k in got if k[0] == "B"]


def test_candidates_in_folds(spark):
    bars = spark.createDataFrame([("A", day(i), float(100 + i)) for i in range(10)], "symbol string, ts timestamp, close double")
    end = "struct<reason:string,price:double,ts:timestamp,i:int>"
    rows = [("A", "v", 3, day(2), 1.0, ("target", 9.0, day(3), 4)), ("A", "v", 5, day(4), 1.0, ("stop", 8.0, day(7), 8)), ("A", "v", 7, day(6), 1.0, ("stop", 8.0, day(7), 8))]
    found = spark.createDataFrame(rows, f"symbol string, variant string, entry_i int, entry_ts timestamp, entry_price double, end {end}")
    folds = spark.createDataFrame([("A", "first", 0, 5), ("A", "rest", 5, 10)], "symbol string, fold string, lo long, hi long")
    got = {(r.fold, r.entry_i): (r.end.reason, r.end.i, r.end.price) for r in trades.in_folds(found, folds, bars).collect()}
    assert got == {("first", 3): ("target", 4, 9.0), ("first", 5): ("end_of_data", 5, 104.0), ("rest", 7): ("stop", 8, 8.0)}


def test_bar_series(spark):
    bars = spark.createDataFrame([("A", day(i), float(c)) for i, c in enumerate((10, 11, 12, 9))], "symbol string, ts timestamp, close double")
    t = spark.createDataFrame([("A", "v", "full", 2, 10.0, 4, 12.0, "max_holding", 10)], "symbol string, variant string, fold string, entry_i int, entry_price double, exit_i int, exit_price double, reason string, n_bars int")
    s = trades.bar_series(t, bars, 0.0, 0.0, 0.0)
    assert [(r.i, round(r.bar_return, 9), r.exposed) for r in s.orderBy("i").collect()] == [(2, 0.1, 1.0), (3, round(12 / 11 - 1, 9), 1.0), (4, 0.0, 0.0)]
    m = trades.series_metrics(s, 252, "symbol", "variant", "fold").first()
    assert m.total_return == pytest.approx(0.2) and m.max_drawdown == 0 and m.exposure == pytest.approx(0.2) and m.sortino == 0


def test_walk_forward_takes_the_first_variant_when_none_has_enough(spark):
    pairs = spark.createDataFrame([("A", "r", "r0", 0), ("A", "r", "r1", 1)], "symbol string, rule string, variant string, idx int")
    rows = [("A", "r1", "train_1", 0.01 + k / 1000) for k in range(6)] + [("A", "r0", "train_1", 0.5)] + [("A", "r1", "test_1", 0.02), ("A", "r0", "test_2", -0.01)]
    t = spark.createDataFrame(rows, "symbol string, variant string, fold string, net_return double")
    got = {r.k: (r.selected, round(r.is_ev, 6), r.oos_ev, r.oos_trades) for r in study.walk_forward(t, pairs, 2).collect()}
    assert got == {1: ("r1", 0.0125, 0.02, 1), 2: ("r0", 0.0, -0.01, 1)}


def test_global_discovery_equals_one_pass(spark):
    tests = spark.range(500).select("id", (F.pmod(F.xxhash64("id"), F.lit(97)) / 500).alias("p"))
    both = study.global_discovery(tests).join(validation.benjamini_hochberg(tests, "p").select("id", "p_adjusted"), "id").collect()
    assert len(both) == 500 and all(r.p_global == pytest.approx(r.p_adjusted) for r in both)


def test_global_discovery_by_group(spark):
    tests = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("b"), F.col("id") % 50)).alias("family"), (F.pmod(F.xxhash64("id"), F.lit(389)) / 500).alias("p"))
    both = study.global_discovery(tests, 0.05, "family").join(validation.benjamini_hochberg(tests, "p", 0.05, "family").select("id", "p_adjusted", "rejected"), "id").collect()
    assert len(both) == 900 and all(r.p_global == pytest.approx(r.p_adjusted) and r.global_rejected == r.rejected for r in both)


def test_monte_carlo(spark):
    rows = [("a", day(k), day(k + 1), 0.1 if k % 2 else -0.05) for k in range(40)] + [("b", day(k), day(k + 1), -0.01) for k in range(5)]
    t = spark.createDataFrame(rows, "key string, entry_ts timestamp, exit_ts timestamp, net_return double")
    got = {r["key"]: r for r in research.monte_carlo(t, "key", sims=2000).collect()}
    again = {r["key"]: r for r in research.monte_carlo(t.repartition(7), "key", sims=2000).collect()}
    assert got == again and got["b"].final_p50 == pytest.approx(0.99**5 - 1) and got["b"].p_loss == 1 and got["b"].drawdown_p50 == pytest.approx(0.99**5 - 1)
    assert got["a"].final_p5 < (1.1 * 0.95) ** 20 - 1 < got["a"].final_p95


def test_news_features(spark):
    t0 = dt.datetime(2024, 3, 1)
    hours = lambda h: t0 + dt.timedelta(hours=h)
    news = [(1, hours(-1), "Quarterly results beat", ["a"]), (1, hours(-1), "Quarterly results beat", ["a"]), (2, hours(-30), "x", ["A", "a"]), (3, hours(0), "x", list("abcdef")), (4, hours(0.95), "late", ["a"])]
    heads = spark.createDataFrame(news, "id int, created_at timestamp, headline string, symbols array<string>")
    covered = spark.createDataFrame([(t0 - dt.timedelta(days=40), t0 + dt.timedelta(hours=2))], "covered_from timestamp, covered_until timestamp")
    bars = spark.createDataFrame([("a", hours(0)), ("a", hours(5)), ("b", hours(0))], "symbol string, ts timestamp")
    got = {(r.symbol, r.ts): (r.news_1d, r.news_ratio, r.news_earnings_1d) for r in feeds.news_features(bars, heads, covered, 3600).collect()}
    assert got == {("a", hours(0)): (1.0, 1 / (1 / 20 + 1), 1.0), ("a", hours(5)): (None, None, None), ("b", hours(0)): (0.0, 0.0, 0.0)}
