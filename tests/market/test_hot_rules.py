"""Rules that change while a stream runs, against the batch extraction of trades."""

import datetime as dt
import itertools
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlab.operators import trades
from marketlab.plans import rules
from marketlab.plans.conditions import Exit, Spec, all_of
from marketlab.streaming import hot_rules
from marketlab.streaming.bars import drain
from tests.market.test_streams import same

T0, DAY = dt.datetime(2024, 1, 1), 86_400
BARS = "symbol string, ts timestamp, open double, high double, low double, close double, atr double, x double, y double"
CROSS = Spec("cross", "cross", all_of(("x", "crosses_above", "y")), Exit(2.0, 3.0, None, None, 6, all_of(("x", "crosses_below", "y"))))
LOW = Spec("low", "low", all_of(("x", "<", "$th")), Exit(1.0, None, None, None, 4), {"th": 0.3})
_n = itertools.count()


def day(n):
    return T0 + dt.timedelta(days=n)


def bar_rows(n=120, symbols="AB", seed=3):
    rng, out = np.random.default_rng(seed), []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i, c in enumerate(close.tolist()):
            o = float(c * np.exp(rng.normal(0, 0.005)))
            out.append((s, day(i), o, max(o, c) * 1.01, min(o, c) * 0.99, c, None if i < 5 else c * 0.01, float(rng.random()), float(rng.random())))
    return out


def log_of(spark, *rows):
    return spark.createDataFrame([(name, symbol, json.dumps(spec.render().data()), action, ts, k) for k, (name, symbol, spec, action, ts) in enumerate(rows)], hot_rules.LOG)


def streamed(spark, tmp_path, parts, logs, history=None):
    """Trades after each part was landed and drained by a query of its own, with the log that held then."""
    base = tmp_path / f"h{next(_n)}"
    os.makedirs(base / "in")
    for i, (rows, log) in enumerate(zip(parts, logs)):
        spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(str(base / "in"))
        bars = hot_rules.with_before(spark.readStream.schema(BARS).parquet(str(base / "in")), ["x", "y"], history)
        hot_rules.decided(bars, lambda _, log=log: log, DAY, str(base)).awaitTermination()
        out = hot_rules.rule_trades(hot_rules.decided_stream(spark, str(base)))
        out.writeStream.format("parquet").option("checkpointLocation", str(base / "trade_state")).trigger(availableNow=True).start(str(base / "trades")).awaitTermination()
    return spark.read.schema(out.schema).parquet(str(base / "trades"))


def batch(spark, rows, spec, lo=0, hi=10**6):
    """The rule's finished trades in batch, of signals on bars numbered from lo up to hi."""
    rule = rules.Rule(spec.name, spec.entry, dict(spec.params), {}, spec.exit.stop_atr_mult, spec.exit.target_atr_mult, spec.exit.max_holding_bars, spec.exit.exit_signal)
    b = rules.prepared(spark.createDataFrame(rows, BARS), (rule,))
    enter, leave = rules.conditions((rule,))
    inside = F.col("ts").between(F.lit(day(lo)), F.lit(day(min(hi, 10**4))))
    kept = trades.single_position(trades.candidates(b, rules.variant_table(spark, (rule,)), enter & inside, leave)).where("reason <> 'end_of_data'")
    return kept.select("symbol", "entry_ts", "entry_price", "exit_ts", "exit_price", "reason").collect()


def of(got, name):
    return got.where(F.col("strategy") == name).select("symbol", "entry_ts", "entry_price", "exit_ts", "exit_price", "reason").collect()


@pytest.mark.parametrize("at", [(), (1, 60, 61)])
def test_equals_batch(spark, tmp_path, at):
    rows = bar_rows()
    log = log_of(spark, ("c", "*", CROSS, "add", T0), ("l", "B", LOW, "add", T0))
    edges = [0, *at, 1000]
    parts = [[r for r in rows if day(a) <= r[1] < day(b)] for a, b in zip(edges, edges[1:])]
    got = streamed(spark, tmp_path, parts, [log] * len(parts)).cache()
    want = batch(spark, rows, CROSS)
    assert {r["reason"] for r in want} >= {"signal", "stop", "target"} and len(want) > 10
    same(of(got, "c"), want)
    same(of(got, "l"), [r for r in batch(spark, rows, LOW) if r["symbol"] == "B"])
    assert got.where("late > 0").count() == 0


def test_rules_come_and_go(spark, tmp_path):
    rows = bar_rows(seed=5)
    first = log_of(spark, ("c", "*", CROSS, "add", T0))
    # From bar 50 on a second rule; the first goes when bar 80 ends, at day 81.
    later = log_of(spark, ("c", "*", CROSS, "add", T0), ("l", "*", LOW, "add", day(51)), ("c", "*", CROSS, "add", day(60)), ("c", "*", CROSS, "remove", day(81)))
    parts = [[r for r in rows if r[1] < day(50)], [r for r in rows if r[1] >= day(50)]]
    got = streamed(spark, tmp_path, parts, [first, later]).cache()
    same(of(got, "l"), batch(spark, rows, LOW, lo=50))
    want = batch(spark, rows, CROSS, hi=79)
    same(of(got, "c"), want)
    told = hot_rules.with_retirement(got, hot_rules.rule_spans(later), DAY).where("strategy = 'c'").collect()
    assert len(told) == len(want) and {r["retired"] for r in told} == {r["exit_ts"] >= day(81) for r in want}


def test_history_signals_nothing(spark, tmp_path):
    rows = bar_rows(seed=7)
    log = log_of(spark, ("c", "*", CROSS, "add", T0))
    history = spark.createDataFrame([r for r in rows if r[1] < day(40)], BARS)
    got = streamed(spark, tmp_path, [[r for r in rows if r[1] >= day(40)]], [log], history)
    same(of(got, "c"), batch(spark, rows, CROSS, lo=40))


def test_late_and_repeated_bars(spark, tmp_path):
    rows = bar_rows(n=60)
    log = log_of(spark, ("c", "*", CROSS, "add", T0))
    early, late = [r for r in rows if r[1] < day(30)], [r for r in rows if r[1] >= day(30)]
    got = streamed(spark, tmp_path, [early, late + early[:7]], [log, log])
    same(of(got, "c"), batch(spark, rows, CROSS))


def test_decisions(spark):
    rows = spark.createDataFrame([("A", T0, 1.0, 1.0, 1.0, 1.0, None, 0.1, 0.2), ("B", T0, 1.0, 1.0, 1.0, 1.0, 0.5, 0.1, 0.2)], BARS).withColumns({"_before_x": F.lit(0.3), "_before_y": F.lit(0.2)})
    percent = Spec("pct", "pct", all_of(("x", "<", 1)), Exit(None, None, 0.05, 0.1, None))
    absent = Spec("news", "news", all_of(("news_1d", ">", 0)), Exit(1.0))
    log = log_of(spark, ("l", "*", LOW, "add", T0), ("p", "A", percent, "add", T0), ("n", "*", absent, "add", T0), ("c", "*", CROSS, "add", T0), ("later", "*", LOW, "add", day(2)), ("gone", "*", LOW, "add", T0), ("gone", "*", LOW, "remove", day(1)), ("edge", "B", LOW, "add", day(1)))
    got = {r["symbol"]: ([e["strategy"] for e in r["entries"]], r["exits"]) for r in hot_rules.decide(rows, hot_rules.rule_spans(log), DAY).collect()}
    # A has no range yet, so no stop in ATRs; a rule added as the bar ends acts on it, one removed then does not.
    assert got == {"A": (["p"], ["c"]), "B": (["edge", "l"], ["c"])}
    none = hot_rules.decide(rows, hot_rules.rule_spans(log.limit(0)), DAY).collect()
    assert [(r["entries"], r["exits"]) for r in none] == [([], []), ([], [])]


def test_changes(spark):
    log = log_of(spark, ("a", "*", LOW, "add", T0), ("b", "*", LOW, "add", T0), ("c", "*", LOW, "add", T0), ("b", "*", LOW, "remove", day(5)), ("c", "*", LOW, "remove", day(5)), ("d", "*", LOW, "add", day(6)), ("x", "*", LOW, "remove", day(1)), ("b", "*", LOW, "add", day(20)))
    spans = hot_rules.rule_spans(log)
    us = lambda n: int(day(n).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert spans.where("strategy = 'b'").count() == 2 and spans.where("strategy = 'x'").count() == 0
    open_trades = spark.createDataFrame([("c",), ("c",)], "strategy string")
    assert dict(map(tuple, hot_rules.rule_changes(spans, us(1), us(10), open_trades).collect())) == {"a": "kept", "b": "removed", "c": "retiring", "d": "added"}
    assert dict(map(tuple, hot_rules.rule_changes(spans, us(10), us(21)).collect())) == {"a": "kept", "b": "added", "d": "kept"}


def test_too_many_rules_are_refused(spark, monkeypatch):
    monkeypatch.setattr(hot_rules, "MOST_RULES", 1)
    log = log_of(spark, ("a", "*", LOW, "add", T0), ("b", "*", LOW, "add", T0))
    with pytest.raises(ValueError, match="more than 1 rules"):
        hot_rules.decide(spark.createDataFrame([], BARS), hot_rules.rule_spans(log), DAY)
