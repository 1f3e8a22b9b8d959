"""Summaries of cycles, confirmation on quotes, verdicts on hypotheses, and briefings that cite what is not there."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marketlab import queries_cycle
from marketlab.operators import briefing, cycle

T0 = dt.datetime(2024, 1, 2, 12)
PAIRS = "timeframe string, symbol string, strategy string, n_hypotheses long, decision string, oos_ev double, oos_trades long, failed array<string>"


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([
        ("1h", "A", "x", 10, "REJECTED", 0.01, 5, ["p", "q"]), ("1h", "B", "x", 10, cycle.CANDIDATE, 0.03, 9, []), ("1d", "A", "x", 4, "REJECTED", None, 0, ["q", "r", "s", "t", "u"]), ("1d", "B", "x", None, "ERROR", None, None, None),
        ("1d", "A", "y", 6, "REJECTED", None, 0, ["q"]), ("1d", "B", "z", None, "ERROR", None, None, ["q"]),
    ], PAIRS)


def test_summary(pairs):
    assert {r["timeframe"]: tuple(r)[1:] for r in cycle.cycle_summary(pairs, "timeframe").collect()} == {"1h": (2, 2, 20, 0, 1), "1d": (4, 2, 10, 0, 0)}
    assert tuple(cycle.cycle_summary(pairs.withColumn("discoveries", F.lit(2))).first()) == (6, 4, 30, 12, 1)
    assert tuple(cycle.cycle_summary(pairs.limit(0)).first()) == (0, 0, 0, 0, 0)
    assert [(r["check"], r["n"]) for r in cycle.failed_checks(pairs).orderBy("place").collect()] == [("q", 3), ("p", 1), ("r", 1), ("s", 1), ("t", 1), ("u", 1)]


def test_write_back(spark, pairs):
    hypotheses = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "never")], "hypothesis int, strategy string")
    rules = spark.createDataFrame([("1h", "B", "x", "x:B:1", True)], "timeframe string, symbol string, strategy string, rule string, promoted boolean")
    got = {r["hypothesis"]: r for r in cycle.write_back(hypotheses, pairs, rules).collect()}
    one = got[1]
    assert (one["symbols_tested"], one["best_symbol"], one["best_oos_ev"], one["best_oos_trades"], one["candidates"], one["rules"], one["status"]) == (3, "B", 0.03, 9, 1, ["x:B:1"], "promoted")
    assert [tuple(f) for f in one["failed_checks"]] == [("q", 2), ("p", 1), ("r", 1), ("s", 1)]
    assert (got[2]["symbols_tested"], got[2]["best_symbol"], got[2]["best_oos_ev"], got[2]["status"]) == (1, "A", None, "rejected")
    assert all((got[k]["symbols_tested"], got[k]["best_symbol"], got[k]["rules"], got[k]["failed_checks"], got[k]["status"]) == (0, None, [], [], "rejected") for k in (3, 4))


def test_confirm(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    quotes = spark.createDataFrame([(s, at(10 * k), k, 100.0 + (k if s == "A" else -k), 100.1 + (k if s == "A" else -k)) for s in "AB" for k in range(100)], "symbol string, ts timestamp, seq long, bid double, ask double")
    signal = lambda strategy, symbol, k: (strategy, symbol, at(60 * k + 5), 0.5, 0.5, 40)
    signals = spark.createDataFrame([signal("up", "A", k) for k in range(10)] + [signal("down", "B", k) for k in range(10)] + [signal("short", "A", k) for k in range(3)] + [signal("pooled", s, k) for s in "AB" for k in (1, 3, 5)], "strategy string, symbol string, ts timestamp, stop_pct double, target_pct double, hold_s long")
    candidates = spark.createDataFrame([("up", at(130)), ("down", at(0)), ("short", at(0)), ("pooled", at(0)), ("silent", at(0))], "strategy string, oos_start timestamp")
    got = {r["strategy"]: r for r in cycle.confirm(candidates, signals, quotes).collect()}
    assert {k: (r["n_trades"], r["passed"]) for k, r in got.items()} == {"up": (7, True), "down": (10, False), "short": (3, False), "pooled": (6, False), "silent": (0, False)}
    assert got["up"]["win_rate"] == 1.0 and got["pooled"]["win_rate"] == 0.5 and got["silent"]["mean_net_return"] == 0.0


def test_confirm_meets_quotes_and_signals_in_one_pass(spark):
    """However long trades are held, quotes and signals are shuffled once each and never joined: the only joins are with the candidates."""
    quotes = spark.range(2000).select(F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("seq"), F.lit(100.0).alias("bid"), F.lit(100.1).alias("ask"))
    signals = quotes.select(F.lit("x").alias("strategy"), "symbol", "ts", F.lit(0.5).alias("stop_pct"), F.lit(0.5).alias("target_pct"), F.when(F.col("seq") < 1000, 500).otherwise(10**6).alias("hold_s"))
    candidates = spark.createDataFrame([("x", dt.datetime(1970, 1, 1))], "strategy string, oos_start timestamp")
    got = cycle.confirm(candidates, signals, quotes)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join ") == 2 and plan.count("RepartitionByExpression") == 1
    assert [r["n_trades"] for r in got.collect()] == [2]


def test_confirm_sends_only_quotes_that_may_fill(spark, monkeypatch):
    """Quotes from before any candidate with signals may trade stay out of the shuffle, whatever a silent candidate's start; trades are the same."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    quotes = spark.createDataFrame([("A", at(k), k, 100.0 + k % 7, 100.1 + k % 7) for k in range(200)] + [("A", None, 200, 1.0, 1.1)], "symbol string, ts timestamp, seq long, bid double, ask double")
    signals = spark.createDataFrame([(s, "A", at(k), 0.02, 0.03, 20) for s in ("late", "later", "other") for k in range(0, 200, 5)], "strategy string, symbol string, ts timestamp, stop_pct double, target_pct double, hold_s long")
    candidates = spark.createDataFrame([("late", at(120)), ("later", at(150)), ("silent", at(0))], "strategy string, oos_start timestamp")
    traded, sent = cycle.ticks.shadow_trades, []
    monkeypatch.setattr(cycle.ticks, "shadow_trades", lambda s, q, *more: sent.append(q) or traded(s, q, *more))
    got = cycle.confirm(candidates, signals, quotes)
    assert sorted(r["seq"] for r in sent[0].collect()) == list(range(120, 200))
    whole = traded(signals.where((F.col("strategy") == "late") & (F.col("ts") >= F.lit(at(120))) | (F.col("strategy") == "later") & (F.col("ts") >= F.lit(at(150)))), quotes.where("ts is not null"), 0.25, 0.001)
    want = {r["strategy"]: (r["n"], r["m"]) for r in whole.groupBy("strategy").agg(F.count("*").alias("n"), F.avg("net_return").alias("m")).collect()}
    assert {r["strategy"]: (r["n_trades"], pytest.approx(r["mean_net_return"])) for r in got.collect()} == want | {"silent": (0, 0.0)} and want["late"][0] > 5
    # Without any candidate that has signals there is no first start, and no trade.
    assert [r["n_trades"] for r in cycle.confirm(candidates.where("strategy = 'silent'"), signals, quotes).collect()] == [0]


def test_confirm_trades_repeated_signals_once(spark):
    """Signals need no shuffle of their own that makes them distinct."""
    at = lambda s: T0 + dt.timedelta(milliseconds=250 * s)
    quotes = spark.createDataFrame([("A", at(k // 2 * 2), k, 100.0 + k * k % 11, 100.1 + k * k % 11) for k in range(120)], "symbol string, ts timestamp, seq long, bid double, ask double")
    signals = spark.createDataFrame([(s, "A", at(k), 0.02, 0.03, 3) for s in "xy" for k in range(0, 130, 3 if s == "x" else 7)], "strategy string, symbol string, ts timestamp, stop_pct double, target_pct double, hold_s long")
    candidates = spark.createDataFrame([("x", at(0)), ("y", at(20))], "strategy string, oos_start timestamp")
    shown = lambda s, latency: sorted(tuple(r) for r in cycle.confirm(candidates, s, quotes, 5, latency).collect())
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for latency in (0.0, 0.25):
                assert shown(signals.union(signals).union(signals.where("strategy = 'x'")), latency) == shown(signals, latency) and shown(signals, latency)[0][1] > 5
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_confirmation_shuffles_quotes_and_signals_only_together(spark, tmp_path):
    spark.createDataFrame([(k, T0 + dt.timedelta(seconds=k), k, "A", float(k), '{"k": 1}') for k in range(8)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    plan = queries_cycle.rs12_confirmation(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()
    # The two aggregates of trades by strategy and of starts by strategy hold a few rows a task; none is by the time of signals.
    assert "Aggregate [strategy" in plan.toString() and not [line for line in plan.toString().splitlines() if "Aggregate [" in line and "ts#" in line.split("]")[0]]


def brief(**more):
    return json.dumps({"market_summary": "calm", **more})


def test_briefings(spark):
    event = lambda ids, symbols, **more: {"headline_ids": ids, "symbols": symbols, "why_it_matters": " w ", **more}
    shown = spark.createDataFrame([(1, 10, "Firm beats quarterly earnings", ["A", "B"]), (1, 11, "Nothing of note", ["C"]), (1, 11, "Nothing of note", ["C"]), (2, 20, "x", ["D"])], "briefing int, id long, headline string, symbols array<string>")
    events = [event([10, 99], ["a", "Z", "a"], type="macro", importance=2), event([20], ["D"]), event(["11", "10", "?"], ["C", "B"], type="gossip", importance=9), "text", event([], []), event([11], [], importance=0)]
    rows = spark.createDataFrame([(1, T0, brief(events=events, watchlist=["c", "a", "Q", "c"])), (2, T0, json.dumps({"events": [event([20], [])]})), (3, T0, brief(events="none", watchlist=3)), (4, T0, None)], "briefing int, made_at timestamp, payload string")
    checked = briefing.checked_events(rows, shown, ["macro", "earnings"]).cache()
    got = {(r["briefing"], r["at"]): r for r in checked.collect()}
    assert {k: r["problem"] for k, r in got.items()} == {(1, 0): None, (1, 1): "no real headline", (1, 2): None, (1, 3): "no event", (1, 4): "no real headline", (1, 5): None, (2, 0): "no summary"}
    a, b, d = got[1, 0], got[1, 2], got[1, 5]
    assert (a["headline_ids"], a["symbols"], a["kind"], a["importance"], a["unknown_ids"], a["invented"], a["why"]) == ([10], ["A"], "macro", 2, 1, 1, "w")
    assert (b["headline_ids"], b["symbols"], b["importance"], b["unknown_ids"], b["invented"], b["place"]) == ([11, 10], ["C", "B"], 5, 1, 0, 1)
    assert (d["importance"], d["place"], a["place"], got[1, 1]["place"]) == (3, 2, 3, None)
    assert b["kind"] == d["kind"] != "gossip"
    assert {r["briefing"]: (r["watchlist"], r["invented"]) for r in briefing.watchlists(rows, shown).collect()} == {1: (["C", "A"], 1), 2: ([], 0), 3: ([], 0), 4: ([], 0)}
    assert sorted((r["briefing"], r["id"]) for r in briefing.cited_headlines(briefing.kept_events(checked), shown).collect()) == [(1, 10), (1, 11)]


def test_at_most_eight_events(spark):
    shown = spark.createDataFrame([(1, 10, "x", ["A"])], "briefing int, id long, headline string, symbols array<string>")
    rows = spark.createDataFrame([(1, T0, brief(events=[{"headline_ids": [10], "importance": 1 + k % 5} for k in range(20)]))], "briefing int, made_at timestamp, payload string")
    kept = briefing.kept_events(briefing.checked_events(rows, shown, [])).orderBy("place").collect()
    assert [(r["importance"], r["at"]) for r in kept] == [(5, 4), (5, 9), (5, 14), (5, 19), (4, 3), (4, 8), (4, 13), (4, 18)]


def test_one_a_day(spark):
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    # 03:00 UTC is still the day before in New York; a briefing without a summary does not take its date.
    rows = spark.createDataFrame([(1, at(2, 14), brief()), (2, at(3, 3), brief()), (3, at(3, 6), "{}"), (4, at(3, 15), brief()), (5, at(3, 15), brief())], "briefing int, made_at timestamp, payload string")
    assert {str(r["date"]): r["briefing"] for r in briefing.one_a_day(rows).collect()} == {"2024-01-02": 1, "2024-01-03": 4}


def test_report_extract(spark):
    lessons = spark.createDataFrame([(k, f"l{k}") for k in range(30)], "seq long, text string")
    runs = spark.createDataFrame([(1, "done", ["old"]), (2, "done", [f"p{k}" for k in range(12)]), (3, "failed", ["no"])], "seq long, status string, top_pairs array<string>")
    trips = spark.createDataFrame([("b", 0.1), ("b", -0.3), ("a", 0.2), ("a", 0.0), ("c", 1.0)], "strategy string, net_return double")
    proposals = spark.createDataFrame([(1, "x", "new", "w" * 500), (2, "y", "done", None)], "seq long, name string, status string, claim string")
    rows = {}
    for r in cycle.report_extract(lessons, runs, trips, proposals).orderBy("part", "place").collect():
        rows.setdefault(r["part"], []).append(r)
    assert [r["text"] for r in rows["lesson"]] == [f"l{k}" for k in range(29, 14, -1)] and [r["name"] for r in rows["pair"]] == [f"p{k}" for k in range(8)]
    assert [(r["name"], r["n"], round(r["mean"], 9), r["win_rate"]) for r in rows["forward"]] == [("a", 2, 0.1, 0.5), ("b", 2, -0.1, 0.5), ("c", 1, 1.0, 1.0)]
    assert [(r["name"], r["text"]) for r in rows["proposal"]] == [("y", "done"), ("x", "new: " + "w" * 160)]
    assert cycle.report_extract(lessons.limit(0), runs.limit(0), trips.limit(0), proposals.limit(0)).count() == 0
