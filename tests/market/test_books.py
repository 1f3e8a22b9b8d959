"""Statistics, throttles and screening against known values and loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlab.functions import columns
from marketlab.operators import desk, ledger, stats, ticks

T0 = dt.datetime(2024, 1, 1)


def test_tail_functions(spark):
    rows = spark.createDataFrame([(2.0, 10.0), (-2.0, 10.0), (0.0, 3.0), (None, 4.0)], "t double, df double")
    got = [r[0] for r in rows.select(stats.student_tail("t", "df")).collect()]
    assert got[:3] == pytest.approx([0.0366940, 0.9633060, 0.5], abs=1e-6) and got[3] is None
    assert rows.limit(1).select(stats.student_quantile(F.lit(0.975), "df")).first()[0] == pytest.approx(2.2281389, abs=1e-6)
    # Beta(3, 5) at one half: the chance of 0, 1 or 2 heads in seven throws.
    assert rows.limit(1).select(stats.beta_tail(F.lit(0.5), F.lit(3.0), F.lit(5.0))).first()[0] == pytest.approx(29 / 128)
    q = stats.beta_quantile(np.array([3.0]), np.array([5.0]), 0.025)
    assert stats.incomplete_beta(np.array([3.0]), np.array([5.0]), q)[0] == pytest.approx(0.025)


def test_mean_test_edges(spark):
    rows = spark.createDataFrame([("one", 0.5), ("flat", 0.1), ("flat", 0.1), ("down", -0.1), ("down", -0.1)], "k string, net_return double")
    got = {r["k"]: r["p"] for r in stats.mean_test(stats.payoffs(rows, "k")).collect()}
    assert got == {"one": 1.0, "flat": 0.0, "down": 1.0}


def test_throttle_matches_a_loop(spark):
    r = random.Random(3)
    rows = [("ab"[r.randrange(2)], T0 + dt.timedelta(seconds=r.random() * 400), f"s{r.randrange(4)}", i) for i in range(200)]
    got = {x["seq"]: x["accepted"] for x in ledger.throttle(spark.createDataFrame(rows, "account string, ts timestamp, symbol string, seq long"), "account", 3, 20.0).collect()}
    accepted: list = []
    for account, ts, symbol, i in sorted(rows, key=lambda x: (x[1], x[3])):
        own = [a for a in accepted if a[0] == account]
        fine = sum((ts - a[1]).total_seconds() < 60 for a in own) < 3 and not any(a[2] == symbol and (ts - a[1]).total_seconds() < 20 for a in own)
        assert got[i] == fine
        if fine:
            accepted.append((account, ts, symbol))


def test_incidents_need_two_bad_samples(spark):
    bad = [0, 1, 0, 1, 1, 1, 0, 0, 1, 1]
    rows = spark.createDataFrame([("m", T0 + dt.timedelta(seconds=i), i, bool(b)) for i, b in enumerate(bad)], "k string, ts timestamp, seq long, bad boolean")
    assert [(x["seq"], x["change"]) for x in ledger.incidents(rows, "k").orderBy("seq").collect()] == [(4, "opened"), (6, "closed"), (9, "opened")]


def test_profiles_hold_the_limits(spark):
    rows = spark.range(101).select(F.col("id").cast("double").alias("level")).withColumns(desk.profile(F.col("level"))).withColumn("bad", desk.profile_violations())
    assert all(r["bad"] == [] for r in rows.collect())


def test_headline_kinds(spark):
    texts = ["Acme IPO priced", "Q3 results beat", "Bank raises its forecast", "Price target cut", "Merger agreed", "FDA clears drug", "Settles lawsuit", "Fed holds rates", "A quiet day"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(columns.headline_kind(F.col("t"))).collect()]
    assert got == ["ipo", "earnings", "guidance", "rating", "m&a", "fda", "legal", "macro", "other"]


def test_headline_kinds_bound_words_as_sql_does(spark):
    import duckdb

    texts = ["ta sues\u00f3\u00f1ar d", "\u00e9fed x", "fed\u0301", "a \u017fues", "x\u017fues", "sue\u017f", "sue\u017fx", "to buy \u017f for", "to buy \u00e9 for", "_fed", "fed_", "tar\u0131ff", "ris\u212a", "FDA\u00e4", "price\u00a0target", "Upgrade\u017f now", "mar\u212aet"]
    sql = "CASE " + " ".join(f"WHEN regexp_matches(t, '(?i){p}') THEN '{k}'" for k, p in columns.HEADLINE_KINDS) + " ELSE 'other' END"
    want = [duckdb.execute(f"SELECT {sql} FROM (SELECT ? AS t)", [t]).fetchall()[0][0] for t in texts]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(columns.headline_kind(F.col("t"))).collect()]
    assert got == want and want[0] == "legal"


def test_shadow_trades(spark):
    quotes = [(i, T0 + dt.timedelta(seconds=i), p - 0.05, p + 0.05) for i, p in enumerate([100, 100, 101, 103, 99, 90, 91, 92, 93, 94])]
    q = spark.createDataFrame([("A", ts, b, a, i) for i, ts, b, a in quotes], "symbol string, ts timestamp, bid double, ask double, seq long")
    s = spark.createDataFrame([("x", "A", T0, 0.05, 0.02, 5), ("x", "A", T0 + dt.timedelta(seconds=2), 0.05, 0.5, 50), ("x", "A", T0 + dt.timedelta(seconds=4), 0.05, 0.5, 3)], "strategy string, symbol string, ts timestamp, stop_pct double, target_pct double, hold_s int")
    got = ticks.shadow_trades(s, q, latency_s=0.0, fee=0.0).orderBy("entry_ts").collect()
    assert [(r["entry_price"], r["exit_price"], r["reason"]) for r in got] == [(100.05, 102.95, "target"), (99.05, 89.95, "stop")]


def test_shadow_trades_across_batches(spark):
    """Trades go on from one batch of rows to the next, also at equal times, and the batches' size changes nothing."""
    r = np.random.default_rng(3)
    at = np.sort(r.integers(0, 120, 400)) * 250_000
    quotes = [("AB"[i % 2], T0 + dt.timedelta(microseconds=int(u)), i, float(p), float(p) + 0.1) for i, (u, p) in enumerate(zip(at, r.uniform(95, 105, 400)))]
    signals = sorted({(str(r.choice(["x", "y"])), "AB"[int(r.integers(2))], T0 + dt.timedelta(microseconds=int(u)), 0.03, 0.04, int(r.choice([0, 1, 60]))) for u in r.integers(0, 120, 90) * 250_000}, key=lambda s: s[:3])
    signals = list({s[:3]: s for s in signals}.values())
    q, s = spark.createDataFrame(quotes, "symbol string, ts timestamp, seq long, bid double, ask double"), spark.createDataFrame(signals, "strategy string, symbol string, ts timestamp, stop_pct double, target_pct double, hold_s int")

    def plain(latency):
        """Each signal looks at every quote."""
        out, lag = [], dt.timedelta(seconds=latency)
        for strategy, symbol in sorted({x[:2] for x in signals}):
            until, own = dt.datetime.min, [x for x in quotes if x[0] == symbol]
            for _, _, ts, stop, target, hold in (x for x in signals if x[:2] == (strategy, symbol)):
                entry = next((x for x in own if x[1] >= ts + lag), None)
                if ts <= until.replace(tzinfo=ts.tzinfo) or entry is None:
                    continue
                end = entry[1] + dt.timedelta(seconds=hold)
                hit = next((x for x in own if x[2] > entry[2] and x[1] <= end and (x[3] <= entry[4] * (1 - stop) or x[3] >= entry[4] * (1 + target))), None)
                exit_ = next((x for x in own if x[1] >= (hit[1] if hit else end) + lag), None)
                until = exit_[1] if exit_ else dt.datetime.max
                if exit_:
                    out.append((symbol, strategy, ts, entry[1], entry[4], exit_[1], exit_[3]))
        return sorted(out)

    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for latency in (0.0, 0.5):
                got = ticks.shadow_trades(s, q, latency).select("symbol", "strategy", "signal_ts", "entry_ts", "entry_price", "exit_ts", "exit_price").collect()
                naive = lambda t: t.replace(tzinfo=T0.tzinfo)
                assert sorted((r[0], r[1], naive(r[2]), naive(r[3]), r[4], naive(r[5]), r[6]) for r in got) == plain(latency) and len(got) > 15
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_shadow_trades_read_dense_quotes_once(spark):
    """Long holds over many quotes make no row a pair of them: only quotes and signals are shuffled."""
    n = 1500
    t = spark.range(n).select(F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("seq"), F.lit(100.0).alias("bid"), F.lit(100.1).alias("ask"))
    s = t.select(F.lit("x").alias("strategy"), "symbol", "ts", F.lit(0.5).alias("stop_pct"), F.lit(0.5).alias("target_pct"), F.lit(10**6).alias("hold_s"))
    plan = ticks.shadow_trades(s, t)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_losing_streaks_go_on_from_day_to_day(spark):
    r = np.random.default_rng(4)
    rows = [("ab"[i % 2] if i % 11 else None, T0 + dt.timedelta(hours=5 * (i // 3)), i, float(r.choice([-1.0, 0.0, 1.0], p=[0.6, 0.2, 0.2])) if i % 13 else None) for i in range(200)]
    frame = spark.createDataFrame(rows, "run_id string, exit_ts timestamp, seq long, pnl double")
    want, now = {}, {}
    for run_id, _, seq, pnl in rows:
        now[run_id] = 0 if pnl is not None and pnl > 0 else now.get(run_id, 0) + (pnl is not None)
        want[seq] = now[run_id]
    got = ledger.losing_streaks(frame, "run_id")
    assert {x["seq"]: x["consecutive_losses"] for x in got.collect()} == want and max(want.values()) > 8
    # No task holds all trips of a run: they are dealt out by run and day.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert all("_day" in line for line in plan.splitlines() if "Window" in line and "pnl" in line)
