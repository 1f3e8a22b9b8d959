"""The panel study: folds on common dates, one observation a date, a planted edge and noise."""

import datetime as dt

import numpy as np
import pytest

from marketlab.operators import panel


def day(i):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=i)


def test_folds_share_their_dates(spark):
    # B begins late, C has every third bar, D has one bar.
    rows = [("A", day(i)) for i in range(90)] + [("B", day(i)) for i in range(60, 90)] + [("C", day(i)) for i in range(0, 90, 3)] + [("D", day(5))]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp").repartition(7)
    edges = {r["name"]: r["ts"] for r in panel.frontiers(bars).collect()}
    assert edges == {"oos": day(62), **{str(k): day(min(15 * k, 89)) for k in range(1, 7)}}
    got = {(r["symbol"], r["fold"]): (r["lo"], r["hi"], r["n_bars"]) for r in panel.fold_bounds(bars).collect()}
    own = {s: sorted(t for x, t in rows if x == s) for s in "ABCD"}
    spans = {"full": (None, None), "is": (None, "oos"), "oos": ("oos", None)} | {f"train_{k}": (None, str(k)) for k in range(1, 6)} | {f"test_{k}": (str(k), str(k + 1) if k < 5 else None) for k in range(1, 6)}
    want = {}
    for s, ts in own.items():
        for fold, (lo, hi) in spans.items():
            a, b = sum(t < edges[lo] for t in ts) if lo else 0, sum(t < edges[hi] for t in ts) if hi else len(ts)
            if b - a >= 2:
                want[s, fold] = (a, b, b - a)
    assert got == want and not [k for k in got if k[0] == "D"]


def test_no_bars(spark):
    assert panel.fold_bounds(spark.createDataFrame([], "symbol string, ts timestamp")).count() == 0


def study_trades(spark, edge, symbols=6, days=720):
    """Trades of three variants on every fourth day, of all symbols at once with nearly the same return."""
    r = np.random.default_rng(4)
    folds = [("full", 0, days), ("is", 0, 504), ("oos", 504, days)] + [f for k in range(1, 6) for f in ((f"train_{k}", 0, 120 * k), (f"test_{k}", 120 * k, 120 * (k + 1)))]
    rows = []
    for v, mean in enumerate(edge):
        for i in range(0, days, 4):
            common = mean + float(r.normal(0, 0.01))
            for s in range(symbols):
                net = common + float(r.normal(0, 0.0005))
                rows += [(f"S{s}", "rule", f"v{v}", f, day(i), day(i + 2), net + 0.003, net) for f, lo, hi in folds if lo <= i < hi]
    t = spark.createDataFrame(rows, "symbol string, rule string, variant string, fold string, entry_ts timestamp, exit_ts timestamp, gross_return double, net_return double")
    grid = spark.createDataFrame([("rule", f"v{v}", v) for v in range(len(edge))], "rule string, variant string, idx int")
    return t, grid


def test_a_planted_edge_is_found(spark):
    (row,) = panel.research(*study_trades(spark, (0.0, 0.006, 0.004)), sims=200).collect()
    assert (row["symbol"], row["rule"], row["selected"], row["failed"], row["decision"]) == ("*", "rule", "v1", [], "CHALLENGER_CANDIDATE")
    assert row["oos_trades"] == 54 and row["n_trades_total"] == 6 * 54 and row["trades_by_symbol"] == {f"S{s}": 54 for s in range(6)}
    assert row["compatibility"] == 0.5 and row["gross_ev"] - row["net_ev"] == pytest.approx(0.003)


def test_noise_is_not_and_symbols_add_no_observations(spark):
    (row,) = panel.research(*study_trades(spark, (0.0, 0.0, -0.001)), sims=200).collect()
    assert row["decision"] == "REJECTED" and "oos_statistically_significant" in row["failed"]
    one, many = (panel.pooled(study_trades(spark, (0.001,), symbols=s)[0]).where("fold = 'oos'").count() for s in (1, 6))
    assert one == many == 54
