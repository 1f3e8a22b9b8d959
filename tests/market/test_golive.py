"""The go-live gate: a run that passes, runs that miss one criterion each, and runs about which little is known."""

import datetime as dt
import math

import pytest

from marketlab.operators import golive

NOW = dt.datetime(2024, 6, 1)
ORDER = ["days", "trades", "net", "edge", "consistency", "buy_hold", "drawdown", "venue", "reconciliation", "kill_switch"]


def back(days, hours=0):
    return NOW - dt.timedelta(days=days, hours=hours)


def good(run):
    """Forty days of hourly samples, sixty winning trades, a switch that was tried."""
    equity = [(run, back(40) + dt.timedelta(hours=h), 1000.0 * 1.0005**h, 100.0 * 1.0001**h) for h in range(960)]
    trips = [(run, "paper", back(39 - k * 0.6), 0.01 + 0.001 * (k % 5), 5.0) for k in range(60)]
    events = [(run, back(41), 1, "session_start"), (run, back(5), 2, "kill_switch_on"), (run, back(4), 3, "kill_switch_off")]
    return equity, trips, events


def judged(spark, runs, equity, trips, events):
    f = golive.figures(
        spark.createDataFrame(runs, "run_id string, now timestamp, max_drawdown double, external boolean"), spark.createDataFrame(equity, "run_id string, ts timestamp, equity double, buy_hold double"),
        spark.createDataFrame(trips, "run_id string, book string, exit_ts timestamp, net_return double, pnl double"), spark.createDataFrame(events, "run_id string, ts timestamp, seq long, kind string"),
    )
    found = golive.criteria(f)
    rows = {}
    for r in found.orderBy("run_id", "place").collect():
        rows.setdefault(r["run_id"], {})[r["criterion"]] = r
    return rows, {r["run_id"]: r for r in golive.verdict(found).collect()}


def test_each_criterion(spark):
    runs, equity, trips, events = [], [], [], []

    def add(run, external=True, limit=0.2, e=lambda x: x, t=lambda x: x, o=lambda x: x):
        a, b, c = good(run)
        runs.append((run, NOW, limit, external))
        equity.extend(e(a)), trips.extend(t(b)), events.extend(o(c))

    add("ok")
    add("young", e=lambda x: [r for r in x if r[1] >= back(20)])
    add("few", t=lambda x: x[:20])
    add("loses", t=lambda x: [(*r[:3], -r[3], -r[4]) for r in x])
    add("flat", t=lambda x: [(*r[:3], 0.01, 5.0) for r in x])
    add("weeks", t=lambda x: [(*r[:4], r[4] if r[2] < back(14) else -5.0) for r in x] + [("weeks", "paper", back(30), 0.02, 500.0)])
    add("lags", e=lambda x: [(*r[:3], 100.0 * 1.001**k) for k, r in enumerate(x)])
    add("falls", limit=0.05, e=lambda x: [(r[0], r[1], r[2] * (0.8 if 300 < k < 400 else 1.0), r[3]) for k, r in enumerate(x)])
    add("inside", external=False)
    add("differs", o=lambda x: [*x, ("differs", back(3), 4, "reconciliation_mismatch")])
    add("untried", o=lambda x: x[:2])
    add("wrong_way", o=lambda x: [(x[1][0], back(3), 2, "kill_switch_on"), x[2]])
    rows, verdicts = judged(spark, runs, equity, trips, events)
    missed = {run: [c for c in ORDER if not rows[run][c]["ok"]] for run in rows}
    assert missed == {"ok": [], "young": ["days", "consistency"], "few": ["trades", "consistency"], "loses": ["net", "edge", "consistency"], "flat": ["edge"], "weeks": ["consistency"], "lags": ["buy_hold"], "falls": ["drawdown"], "inside": ["venue", "reconciliation"], "differs": ["reconciliation"], "untried": ["kill_switch"], "wrong_way": ["kill_switch"]}
    assert all(verdicts[run]["missing"] == ", ".join(names) and verdicts[run]["ready"] == (not names) and verdicts[run]["passed"] == 10 - len(names) for run, names in missed.items())
    assert rows["young"]["days"]["progress"] == pytest.approx(20 / 28) and rows["few"]["trades"]["progress"] == pytest.approx(0.4)
    assert rows["flat"]["edge"]["value"] == 1.0 and rows["flat"]["edge"]["progress"] == 0.0
    assert rows["falls"]["drawdown"]["value"] == pytest.approx(1 - 0.8 * 1.0005, rel=1e-6) and rows["falls"]["drawdown"]["progress"] == pytest.approx(0.05 / (1 - 0.8 * 1.0005), rel=1e-6)
    assert rows["ok"]["buy_hold"]["value"] == pytest.approx(math.expm1(959 * math.log(1.0005))) and verdicts["ok"]["progress"] == 1.0


def test_sessions_weeks_and_ruin(spark):
    # A step over a session start or a long gap counts for neither side; a trip exactly at now is not over yet, one at the end of four weeks is in.
    equity = [("s", back(2), 100.0, 10.0), ("s", back(2, -0.5), 110.0, 10.0), ("s", back(1), 500.0, 90.0), ("s", back(1, -0.5), 550.0, 90.0), ("s", back(1, -0.6), 10.0, 1.0)]
    equity += [("r", back(2), 100.0, 10.0), ("r", back(2, -0.5), 0.0, 10.0), ("r", back(2, -0.8), 50.0, 10.0)]
    trips = [("s", "paper", NOW, 0.1, 1.0), ("s", "paper", back(28), 0.1, 1.0), ("s", "paper", back(7), 0.1, 1.0), ("s", "shadow", back(1), 0.1, 1.0)]
    rows, _ = judged(spark, [("s", NOW, 0.2, True), ("r", NOW, 0.2, True)], equity, trips, [("s", back(1, -0.55), 1, "session_start")])
    assert rows["s"]["buy_hold"]["value"] == pytest.approx(1.1 * 1.1 - 1) and rows["s"]["buy_hold"]["target"] == pytest.approx(0.0)
    assert rows["s"]["consistency"]["value"] == 2 and rows["s"]["trades"]["value"] == 3
    assert rows["r"]["buy_hold"]["value"] == -1.0 and rows["r"]["drawdown"]["value"] == 1.0 and not rows["r"]["drawdown"]["ok"]


def test_nothing_known(spark):
    rows, verdicts = judged(spark, [("new", NOW, 0.2, None)], [], [], [])
    assert not any(r["ok"] for r in rows["new"].values()) and len(rows["new"]) == 10
    assert verdicts["new"]["passed"] == 0 and verdicts["new"]["progress"] == 0.0 and not verdicts["new"]["ready"]
