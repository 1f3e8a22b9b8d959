"""Meta-labelling: a planted rule is found out of fold, noise is refused, and the filter applies what was learned."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlab.functions import boosting
from marketlab.operators import meta

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "strategy string, exit_ts timestamp, seq long, net_return double, context map<string,double>"


def trades(strategy, n=240, seed=0, planted=True, constant=None):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        flow, noise = float(r.uniform(-1, 1)), float(r.normal())
        win = flow > 0.3 if planted else r.random() < 0.35
        net = (0.006 if win else -0.004) + float(r.normal(0, 0.001)) if constant is None else constant
        context = {"flow": flow, "noise": noise, "close": 100.0 + i, "ts": 1e9 + i, "sma_20": 1.0, "macd_hist": 0.1}
        if i % 10 == 0:
            context["noise"] = float("nan") if i % 20 else None
        rows.append((strategy, T0 + dt.timedelta(hours=i // 2), i, net, context))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = trades("good") + trades("noise", seed=3, planted=False) + trades("few", 20) + trades("same", 80, constant=0.01) + [("levels", T0, i, (-1.0) ** i, {"close": 1.0, "ema_200": 2.0}) for i in range(70)] + [("none", T0, 1, None, {"flow": 1.0}), ("none", T0, 2, 0.1, None)]
    return meta.learn(spark.createDataFrame(rows, SCHEMA).repartition(3)).cache()


def test_a_planted_rule_is_found(learned):
    r = learned.where("strategy = 'good'").first()
    assert r["accepted"] and r["reason"].startswith("filtered trades beat") and r["ev_all"] < 0 < r["ev_kept"] and 0 < r["kept_fraction"] < 0.6 and r["p_value"] < 0.05
    assert r["features"] == ["flow", "noise"] and r["importance"][0]["name"] == "flow" and sum(s["share"] for s in r["importance"]) == pytest.approx(1)


def test_noise_and_thin_evidence_are_refused(learned):
    got = {r["strategy"]: (r["accepted"], r["reason"]) for r in learned.collect()}
    assert not got["noise"][0] and set(got) == {"good", "noise", "few", "same", "levels"}
    assert got["few"] == (False, "only 20 trades (< 60)") and got["same"] == (False, "all trades have the same outcome") and got["levels"] == (False, "no usable features")


def test_too_few_kept(spark):
    r = meta.learn(spark.createDataFrame(trades("good", 100), SCHEMA), meta.Config(least_kept=10_000)).first()
    assert not r["accepted"] and r["reason"] == "filter keeps too few trades" and r["ev_all"] is not None and r["digest"] is None


def test_examples_fill_gaps_with_medians_and_keep_the_latest(spark):
    rows = [("s", T0 + dt.timedelta(hours=h), h, float(h), c) for h, c in enumerate([{"a": 9.0}, {"a": 1.0, "b": 5.0}, {"b": float("inf")}, {"a": 3.0, "high": 2.0}, {"a": None, "b": 7.0}])]
    got = meta.examples(spark.createDataFrame(rows, SCHEMA), meta.Config(most=4)).orderBy("i").collect()
    assert [(r["i"], r["net_return"], r["features"], r["x"]) for r in got] == [(0, 1.0, ["a", "b"], [1.0, 5.0]), (1, 2.0, ["a", "b"], [2.0, 6.0]), (2, 3.0, ["a", "b"], [3.0, 6.0]), (3, 4.0, ["a", "b"], [2.0, 7.0])]


def test_scores_come_from_models_that_did_not_see_the_trade(spark):
    """A trade's outcome is turned round: its own score must not move, and those of folds that train on it must."""
    rows = meta.examples(spark.createDataFrame(trades("good", 100), SCHEMA)).cache()
    turned = rows.withColumn("net_return", F.when(F.col("i") == 50, -F.col("net_return")).otherwise(F.col("net_return")))
    p = [{r["i"]: (r["k"], r["p"]) for r in meta.out_of_fold(x, meta.models(x)).collect()} for x in (rows, turned)]
    # Fold 2 is trades 40 to 59; with the embargo of two, no other fold leaves trade 50 out.
    assert all((p[0][i] == p[1][i]) == (40 <= i < 60) for i in range(100)) and {k for k, _ in p[0].values()} == set(range(5))
    parts = meta._fold_rows(rows, meta.Config()).where("k = 2 and part = 'train'").select("i").collect()
    assert {r["i"] for r in parts} == set(range(38)) | set(range(62, 100))


def test_probability_in_spark_equals_the_trees(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    base, trees, gain = boosting.fit(x, y, 1)
    names = ("f", "t", "lf", "lt", "rf", "rt", "v")
    frame = spark.createDataFrame([(i, v.tolist(), base, [dict(zip(names, t)) for t in trees]) for i, v in enumerate(x)], f"i int, x array<double>, base double, trees array<{boosting.TREE}>")
    got = np.array([s["p"] for s in frame.select("i", boosting.probability(F.col("base"), F.col("trees"), F.col("x")).alias("p")).orderBy("i").collect()])
    score = np.full(200, base)
    for f, t, lf, lt, rf, rt, v in trees:
        left = x[:, f] <= t
        score += boosting.RATE * np.where(left, np.where(x[:, lf] <= lt, v[0], v[1]), np.where(x[:, rf] <= rt, v[2], v[3]))
    assert np.allclose(got, 1 / (1 + np.exp(-score))) and ((got > 0.5) == y).mean() > 0.9 and gain[2] < 0.2


def test_the_filter_lets_good_signals_through(spark, learned):
    signals = spark.createDataFrame([(1, "good", {"flow": 0.9, "noise": 0.0}), (2, "good", {"flow": -0.9}), (3, "noise", {"flow": 0.9}), (4, "good", {})], "id int, strategy string, context map<string,double>")
    got = meta.filtered(signals, learned).collect()
    assert [(r["id"], r["strategy"]) for r in got] == [(1, "good~meta")] and got[0]["p_win"] > 0.6
    with pytest.raises(Exception, match="does not match its digest"):
        meta.filtered(signals, learned.withColumn("base", F.col("base") + 1)).collect()


def test_scan_takes_the_first_of_equal_thresholds(spark):
    rows = [("s", 0.01 if p > 0.5 else -0.01, p) for p in [0.4] * 30 + [0.7] * 30] + [("s", 0.5, None)]
    (r,) = meta.scan(spark.createDataFrame(rows, "strategy string, net_return double, p double")).collect()
    assert (r["threshold"], r["kept"], r["kept_fraction"], r["ev_all"], r["ev_kept"], r["p_value"]) == (0.45, 30, 0.5, pytest.approx(0.0), pytest.approx(0.01), 0.0)
    assert pd.isna(meta.scan(spark.createDataFrame(rows[:5], "strategy string, net_return double, p double")).first()["threshold"])


def test_a_model_is_checked_once_and_sent_to_the_signals(spark, learned):
    """Signals of one strategy are not gathered in one task, and no signal hashes its model."""
    signals = spark.createDataFrame([(1, "good", {"flow": 0.9})], "id int, strategy string, context map<string,double>")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = meta.filtered(signals, learned)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in plan.split("BroadcastExchange")[0] and "raise_error" not in plan.split("BroadcastExchange")[0] and "BroadcastHashJoin" in plan


def test_a_strategy_learns_from_all_its_trades(spark):
    """Over 5000 trades, the first half of which turns on ``early``: what was cut off before is counted and learned."""
    r = np.random.default_rng(5)
    early, late = r.uniform(-1, 1, 6000), r.uniform(-1, 1, 6000)
    wins = np.where(np.arange(6000) < 900, early > 0, late > 0.95)
    rows = [("s", T0 + dt.timedelta(hours=i // 3), i, 0.01 if w else -0.01, {"early": float(a) if i < 900 else -2.0, "late": float(b)}) for i, (a, b, w) in enumerate(zip(early, late, wins.tolist()))]
    (got,) = meta.learn(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert got["n_trades"] == 6000 and got["importance"][0]["name"] == "early" and got["ev_all"] == pytest.approx(0.01 * (2 * wins.mean() - 1))
    assert meta.examples(spark.createDataFrame(rows, SCHEMA)).where("i < 900 and x[0] > -2").count() == 900


def _many(spark, n=3000):
    r = np.random.default_rng(8)
    rows = [("s" if i % 3 else "t", T0 + dt.timedelta(hours=i // 50), (i * 7919) % n, float(r.normal()), {"a": float(r.integers(0, 5)), "b": float(r.normal()), "c": 0.0 if i % 2 else -0.0}) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_trades_are_put_in_order_by_ranges(spark):
    rows, frame = _many(spark)
    got = [(r["strategy"], r["i"], r["n"], r["net_return"]) for r in meta.examples(frame).collect()]
    want = []
    for s in "st":
        own = sorted((x[1:3], x[3]) for x in rows if x[0] == s)
        want += [(s, i, len(own), r) for i, (_, r) in enumerate(own)]
    assert sorted(got) == sorted(want)


def test_limits_of_bins_are_the_quantiles_of_the_training_trades(spark):
    rows = meta.examples(_many(spark)[1]).cache()
    held, cfg = rows.collect(), meta.Config()
    for r in meta._limits(rows, cfg).collect():
        own = [x for x in held if x["strategy"] == r["strategy"]]
        lo, hi = len(own) * r["k"] // 5 - 2, len(own) * (r["k"] + 1) // 5 + 2
        x = np.array([v["x"] for v in own if r["k"] < 0 or not lo <= v["i"] < hi])
        assert [list(np.unique(np.quantile(c, np.linspace(0, 1, boosting.BINS + 1)[1:-1]))) for c in x.T] == r["limits"]
    assert meta._limits(rows, cfg).count() == 12


def test_equal_examples_are_fitted_as_one(spark):
    """A hundred million of them, given by number, take no more than their cells."""
    codes, counts = np.array([[0, 0], [0, 1], [1, 0], [1, 1]], np.uint8), np.array([[30, 20], [25, 25], [10, 40], [5, 45]]) * 500_000
    base, trees, gain = boosting.fit_cells(codes, counts, [np.array([0.5]), np.array([0.5])], 3)
    x = np.array([[0.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 1.0]])
    p = boosting.scored(base, [np.array(c) for c in zip(*(t[:6] for t in trees))], np.array([t[6] for t in trees]), x)
    assert np.allclose(p, [0.4, 0.5, 0.8, 0.9], atol=0.01) and gain[0] > 0.8
    wide = np.random.default_rng(1).integers(0, 2, (500, 14)).astype(np.uint8)
    y = (np.arange(500) % 3 == 0).astype(float)
    found, number = boosting.cells(wide, y)
    assert np.array_equal(found, np.unique(wide, axis=0)) and number.sum(0).tolist() == [500 - y.sum(), y.sum()]
