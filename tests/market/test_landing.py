"""Tables that grow run by run: pruned tick reads, days that were not over, overlapping pulls, repeated batches, versions, fingerprints."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlab.sources import landing

T0 = dt.datetime(2024, 1, 1)
at = lambda day, hour=0: T0 + dt.timedelta(days=day, hours=hour)


def test_tick_log(spark, tmp_path):
    path = str(tmp_path / "ticks")
    rows = [(s, at(d, h), i, "Q") for i, (s, d, h) in enumerate((s, d, h) for d in range(5) for h in (0, 7, 7, 23) for s in "AB")]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, kind string")
    landing.write_ticks(ticks, path)
    landing.write_ticks(ticks.where("symbol = 'A'"), path)  # the same days again change nothing
    got = landing.read_ticks(spark, path, at(1, 7), at(3), ["A"])
    assert [(r["ts"], r["seq"]) for r in got.collect()] == [(t, i) for s, t, i, _ in rows if s == "A" and at(1, 7) <= t < at(3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "symbol" in plan.split("PartitionFilters")[1].split("]")[0]
    assert {tuple(r) for r in landing.tick_summary(ticks).collect()} == {(s, "Q", 20, at(0), at(4, 23)) for s in "AB"}


def test_days_that_are_over_are_not_asked_for_again(spark, tmp_path):
    root, want = str(tmp_path), lambda: sorted(r["day"].day for r in landing.wanted_days(spark, str(tmp_path), dt.date(2024, 1, 1), dt.date(2024, 1, 8)).collect())
    bars = lambda *days: spark.createDataFrame([(at(d - 1, h),) for d in days for h in (1, 2)], "ts timestamp")
    assert want() == [1, 2, 3, 4, 5, 8]
    days = landing.wanted_days(spark, root, dt.date(2024, 1, 1), dt.date(2024, 1, 4))
    landing.land_days(bars(1, 3, 4), root, days, at(3, 12))  # the 2nd has no bars; the 4th is running
    assert want() == [4, 5, 8]
    landing.land_days(bars(1, 3, 4).union(bars(4)), root, landing.wanted_days(spark, root, dt.date(2024, 1, 4), dt.date(2024, 1, 4)), at(4))
    known = {r["day"].day: (r["n"], r["complete"]) for r in landing.known_days(spark, root).collect()}
    assert known == {1: (2, True), 2: (0, True), 3: (2, True), 4: (4, True)} and want() == [5, 8]
    assert {r["day"].day: r["count"] for r in spark.read.parquet(f"{root}/bars").groupBy("day").count().collect()} == {1: 2, 3: 2, 4: 4}


def test_overlapping_pulls_give_each_headline_once(spark, tmp_path):
    root, schema = str(tmp_path), "id long, created_at timestamp, headline string"
    all_ = [(i, at(0) + dt.timedelta(minutes=5 * i), "h") for i in range(20)]
    pull = lambda a, b: spark.createDataFrame([r for r in all_ if a <= r[1] < b] + [(3, at(0), "older copy")], schema)
    first = at(0, 1)
    assert landing.covered(spark, root) is None and landing.pull_from(spark, root, first) == first - dt.timedelta(days=22)
    landing.land_headlines(pull(at(-9), first), root, first - dt.timedelta(days=22), first)
    since = landing.pull_from(spark, root, at(0, 2))
    assert since == first - dt.timedelta(minutes=10)
    for _ in range(2):  # a run that is run again
        landing.land_headlines(pull(since, at(0, 2)), root, since, at(0, 2))
    rows = spark.read.parquet(f"{root}/headlines").collect()
    assert sorted(r["id"] for r in rows) == list(range(20)) and {r["headline"] for r in rows} == {"h"}
    assert landing.covered(spark, root) == (first - dt.timedelta(days=22), at(0, 2))


def test_a_stream_forgets_no_id_within_the_overlap(spark, tmp_path):
    schema = "id long, created_at timestamp"
    for k, rows in enumerate([[(1, at(0)), (2, at(0))], [(2, at(0)), (1, at(0)), (3, at(0, 1))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = landing.once_on_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


LOG = "run_id string, order_id long, ts timestamp, seq long, kind string, symbol string, side string, quantity double, status string, price double, fee double"


def test_repeated_batches_and_order_state(spark, tmp_path):
    order = lambda i, seq, q, status: ("r", i, at(0), seq, "order", "S", "buy", q, status, None, None)
    fill = lambda i, h, price: ("r", i, at(0, h), 1, "fill", None, None, None, None, price, 0.1)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([order(1, 1, 5.0, "SENT"), order(2, 1, 5.0, "SENT"), order(1, 2, 6.0, "NEW")], [fill(1, 1, 9.0), fill(1, 2, 10.0), fill(7, 1, 1.0)]):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(source)
        landing.audit(spark.readStream.schema(LOG).parquet(source), out, str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(out)
    assert sorted(r["batch"] for r in rows.select("batch").distinct().collect()) == [0, 1] and rows.count() == 6
    landing.land_batch(spark.createDataFrame([fill(1, 1, 9.0), fill(1, 2, 10.0), fill(7, 1, 1.0)], LOG), out, 1)
    state = {r["order_id"]: (r["quantity"], r["status"], r["fill_price"], r["fill_ts"]) for r in landing.order_state(spark.read.parquet(out)).collect()}
    assert state == {1: (6.0, "FILLED", 10.0, at(0, 2)), 2: (5.0, "SENT", None, None)}


def test_versions_go_on_from_the_largest(spark):
    none = spark.createDataFrame([], "strategy string, version int, hash string")
    specs = lambda *r: spark.createDataFrame(r, "strategy string, spec string")
    one = landing.new_versions(specs(("a", "x"), ("a", "y"), ("a", "x"), ("b", "x")), none).cache()
    assert sorted((r["strategy"], r["version"]) for r in one.collect()) == [("a", 1), ("a", 2), ("b", 1)]
    two = landing.new_versions(specs(("a", "y"), ("a", "z"), ("c", "z")), one)
    assert sorted((r["strategy"], r["version"], r["spec"]) for r in two.collect()) == [("a", 3, "z"), ("c", 1, "z")]
    assert landing.new_versions(specs(("a", "x")), one).count() == 0


def test_flat_study(spark):
    v = spark.createDataFrame([("S", "r", "v1", "REJECTED", 0.2, 7, 0.01, 0.3)], "symbol string, rule string, selected string, decision string, is_p double, oos_trades long, oos_ev double, oos_p double")
    w = spark.createDataFrame([("S", "r", 1, "v1", 0.1, 0.2, 3)], "symbol string, rule string, k int, selected string, is_ev double, oos_ev double, oos_trades long")
    t = landing.flat_study(v, w)
    assert [(r["sample"], r["n_trades"], r["p"]) for r in t["backtests"].collect()] == [("IS", None, 0.2), ("OOS", 7, 0.3)] and t["walk_forward_runs"].count() == t["strategies"].count() == 1


def test_fingerprints(spark):
    rows = [("A", i, float(i), None if i % 3 else "x") for i in range(50)] + [("B", 1, 1.0, "x")]
    frame = lambda r: spark.createDataFrame(r, "symbol string, ts long, close double, note string")
    prints = lambda df: {r["symbol"]: r["fingerprint"] for r in landing.fingerprint(df, ["ts", "close", "note"]).collect()}
    base = prints(frame(rows))
    assert base == prints(frame(rows[::-1]).repartition(7)) and base["A"] != base["B"]
    changed = prints(frame([(s, t, c + (t == 40), n) for s, t, c, n in rows]))
    assert changed["A"] != base["A"] and changed["B"] == base["B"]
    assert prints(frame([("A", 1, 1.0, None)])) != prints(frame([("A", 1, 1.0, "")])) and prints(frame(rows + rows[:1]))["A"] != base["A"]
    whole = lambda df: landing.study_fingerprint(landing.fingerprint(df, ["ts", "close", "note"])).first()["fingerprint"]
    assert whole(frame(rows)) == whole(frame(rows).repartition(5, F.rand(1))) != whole(frame(rows[1:]))


@pytest.mark.parametrize("name", ["headlines", "days"])
def test_nothing_landed_yet(spark, tmp_path, name):
    assert landing.known_days(spark, str(tmp_path / name)).count() == 0 and landing.covered(spark, str(tmp_path / name)) is None


def test_order_state_deals_orders_out_before_it_sorts(spark):
    plan = landing.order_state(spark.createDataFrame([], LOG))._jdf.queryExecution()
    steps = [line for line in plan.sparkPlan().toString().splitlines() if "Aggregate" in line or "Repartition" in line or "Exchange" in line or "RebalancePartitions" in line]
    assert "Aggregate" in steps[0] and "run_id" in steps[-1] and "Aggregate" not in steps[-1]
