"""Rules as data: comparisons, crossings, nesting, negation, missing values, parameters, identity, and proposals."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from marketlab.functions.columns import numeric_context
from marketlab.plans import proposals, rules
from marketlab.plans.conditions import Condition, Exit, Group, Spec, all_of, exit_of, group, rule_id, signals, with_previous

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    values = [(1.0, 2.0), (2.0, 2.0), (3.0, 2.0), (2.0, 2.0), (None, 2.0), (float("nan"), 2.0), (5.0, 2.0)]
    data = [(s, T0 + dt.timedelta(days=i), a, b) for s in "XY" for i, (a, b) in enumerate(values)]
    return spark.createDataFrame(data, "symbol string, ts timestamp, a double, b double").repartition(3)


def held(rows, part, params=None):
    g = part if isinstance(part, Group) else all_of(part)
    p = F.create_map(*(x for k, v in (params or {"none": 0.0}).items() for x in (F.lit(k), F.lit(float(v)))))
    out = with_previous(rows, [g]).withColumn("p", p).withColumn("hit", g.column()).where("symbol = 'X'").orderBy("ts")
    return "".join("1" if r["hit"] else "0" for r in out.collect())


@pytest.mark.parametrize("part, want", [
    (("a", ">", "b"), "0010001"), (("a", ">=", 2), "0111001"), (("a", "<", 2), "1000000"), (("a", "<=", 2), "1101000"), (("a", "==", 2), "0101000"), (("a", "!=", 2), "1010001"),
    (("a", "crosses_above", "b"), "0010000"), (("a", "crosses_below", 2.5), "0001000"), (("a", "crosses_above", 1.5), "0100000"), (("a", ">", "$th"), "0010001"), (("a", "crosses_above", "$th"), "0010000"), (("a", ">", "$unknown"), "0000000"),
])
def test_conditions(rows, part, want):
    assert held(rows, part, {"th": 2.5}) == want


def test_groups(rows):
    assert held(rows, all_of(("a", ">=", 2), any_of=[("a", "==", 3), ("a", "<", 2.5)])) == "0111000"
    assert held(rows, group({"any_of": [("a", "==", 1), {"left": "a", "op": ">", "right": 4}]})) == "1000001"
    # Missing values are false before the group is turned round.
    assert held(rows, group({"all_of": [("a", ">", 1)], "negate": True})) == "1000110"
    assert held(rows, group({"all_of": [{"any_of": [("a", ">", 2)], "negate": True}, ("a", "<", 9)]})) == "1101000"
    nested = group({"all_of": [("a", "<", "$x"), {"any_of": [("c", "crosses_above", "d"), ("e", ">", 1)], "negate": True}]})
    assert nested.features() == {"a", "c", "d", "e"} and nested.crossing() == {"c", "d"} and nested.parameters() == {"x"} and group(nested.data()) == nested


@pytest.mark.parametrize("bad", [{}, {"all_of": []}, {"all_of": [("a", "~", 1)]}, {"all_of": [("a", ">", None)]}, {"all_of": [("a", ">", True)]}, {"all_of": [("$a", ">", 1)]}, {"all_of": ["a > 1"]}, {"some_of": [("a", ">", 1)]}, []])
def test_bad_groups(bad):
    with pytest.raises(ValueError):
        group(bad)


def test_exits_need_a_stop():
    with pytest.raises(ValueError, match="stop"):
        exit_of({"stop_atr_mult": None})
    assert exit_of({"stop_atr_mult": None, "stop_pct": 0.05}).stop_pct == 0.05 and Exit().max_holding_bars == 20


def test_render_variants_and_identity():
    spec = Spec("t", "x", all_of(("a", "<", "$th")), Exit("$s"), {"th": 2, "s": 1.5})
    done = spec.render()
    assert done.entry.all_of[0] == Condition("a", "<", 2) and done.exit.stop_atr_mult == 1.5
    with pytest.raises(ValueError, match="nope"):
        Spec("t", "x", all_of(("a", "<", "$nope"))).render()
    points = spec.variants({"th": [1, 2, 3], "s": [1.0, 2.0]})
    assert [p.name for p in points][:2] == ["t[th=1,s=1.0]", "t[th=1,s=2.0]"] and len({p.digest() for p in points}) == 6
    text = '{"description": "", "entry": {"all_of": [{"left": "a", "op": "<", "right": 2}], "any_of": [], "negate": false}, "exit": {"exit_signal": null, "max_holding_bars": 20, "stop_atr_mult": 1.5, "stop_pct": null, "target_atr_mult": null, "target_pct": null}, "family": "x", "name": "t", "params": {"s": 1.5, "th": 2}, "version": 1}'
    own = hashlib.sha256(text.encode()).hexdigest()[:8]
    assert rule_id(spec, "S") == f"x:S:{own}" and rule_id(spec, "S", 3600.0) == f"x:S:{own}@1h" and rule_id(spec, "S", 30.0) == f"x:S:{own}@30s"


def test_rules_on_absent_features_are_skipped(rows):
    out = signals(rows, [Spec("up", "x", all_of(("a", "crosses_above", "b"))), Spec("gone", "x", all_of(("zzz", ">", 1)))])
    assert out.columns == [*rows.columns, "up"]
    have = ["close", "prev_high_20", "volume_ratio", "ema_50", "ema_200", "momentum_20"]
    assert [r.name for r in rules.runnable(rules.DAILY + rules.SWING, have)] == ["breakout", "trend_follow", "breakout_volume"]
    assert all(r.spec().render().features() == r.spec().features() for r in rules.DAILY + rules.INTRADAY + rules.SWING)


GOOD = {"name": "Dip_Buyer", "timeframe": "1d", "entry": {"all_of": [{"left": "rsi", "op": "<", "right": "$th"}]}, "exit": {"stop_atr_mult": 2.0, "max_holding_bars": 5}, "params": {"th": 30}, "grid": {"th": [20, 30]}, "claim": "c"}


@pytest.mark.parametrize("change, why", [
    ({}, None), ({"name": "2x"}, "invalid name"), ({"timeframe": "3m"}, "not allowed"), ({"params": {"th": "x"}}, "not a number"), ({"params": {"th": True}}, "not a number"), ({"params": [1]}, "objects"), ({"grid": {"zz": [1]}}, "without a default"), ({"grid": {"th": []}}, "1 to 4"),
    ({"params": {"th": 1, "u": 1}, "grid": {"th": [1, 2, 3], "u": [1, 2, 3]}}, "9 combinations"), ({"entry": None}, "invalid rule"), ({"entry": {"all_of": [{"left": "rsi", "op": "<", "right": "$u"}]}}, "unresolved"), ({"entry": {"all_of": [{"left": "moon", "op": "<", "right": 1}]}}, "unknown features"),
    ({"exit": {"stop_atr_mult": 2.0, "max_holding_bars": None}}, "max_holding_bars"), ({"exit": {"stop_atr_mult": None}}, "stop"), ({"exit": {"stops": 1}}, "unknown parts"),
])
def test_proposals(change, why):
    if why:
        with pytest.raises(ValueError, match=why):
            proposals.checked(GOOD | change, {"rsi"}, ("1d",))
    else:
        spec, timeframe, grid = proposals.checked(GOOD, {"rsi"}, ("1d",))
        assert (spec.name, spec.family, timeframe, grid) == ("ai_dip_buyer", "ai", "1d", {"th": [20, 30]})


def test_proposals_as_rows(spark):
    texts = [json.dumps(GOOD), json.dumps(GOOD | {"name": "other_name"}), json.dumps(GOOD | {"params": {"th": 31}}), "{", None, "[1]", '"x"']
    frame = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "id int, payload string, reason string")
    done = proposals.validate(frame, {"rsi"}, ("1d",))
    got = {r["id"]: r for r in done.collect()}
    assert got[0]["rule_key"] == got[1]["rule_key"] != got[2]["rule_key"] and [got[i]["reason"] for i in (3, 4, 5, 6)] == ["not JSON", "not JSON", "a proposal is an object", "a proposal is an object"]
    assert json.loads(got[0]["spec"])["name"] == "ai_dip_buyer"
    assert [r["id"] for r in proposals.new_ones(done, done.limit(0), "id").orderBy("id").collect()] == [0, 2]
    assert [r["id"] for r in proposals.new_ones(done, done.where("id = 2"), "id").collect()] == [0]


def test_numeric_context(spark):
    row = spark.createDataFrame([(1, 2.5, True, "x", float("nan"), float("inf"), None, 9.0)], "i int, d double, b boolean, s string, n double, inf double, none double, out double")
    assert row.select(numeric_context(row, "out").alias("c")).first()["c"] == {"i": 1.0, "d": 2.5, "b": 1.0}
    assert row.select("s").select(numeric_context(row.select("s")).alias("c")).first()["c"] == {}


def test_proposals_of_one_file_are_checked_by_many_tasks(spark):
    frame = spark.createDataFrame([(i, json.dumps(GOOD)) for i in range(200)], "id int, payload string").coalesce(1)
    done = proposals.validate(frame, {"rsi"}, ("1d",))
    assert done.select(F.spark_partition_id()).distinct().count() > 4 and done.where("reason is null").count() == 200
