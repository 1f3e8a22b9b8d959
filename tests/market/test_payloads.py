"""Payloads and files with parts that cannot be read: what comes out, and what is told of the rest."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from marketlab.sources import bar_files, payloads

T0 = dt.datetime(2024, 1, 2)


def landed(spark, *objects, **more):
    rows = [(s, k, o if isinstance(o, str) or o is None else json.dumps(o)) for k, (s, o) in enumerate(objects)]
    return spark.createDataFrame(rows, "symbol string, seq long, payload string")


def told(rows, *keys):
    return {tuple(r[k] for k in (*keys, "problem")): r["n"] for r in payloads.problems(rows, *keys).collect()}


def test_messages(spark):
    book = {"s": "btc", "b": "1.5", "B": "2", "a": "1.6", "A": 3}
    trade = {"e": "aggTrade", "s": "eth", "p": "10", "q": "0.5", "m": True}
    rows = payloads.messages(landed(
        spark, ("x", {"stream": "btc@bookTicker", "data": book}), ("x", book), ("x", {"stream": "eth@aggTrade", "data": trade}), ("x", trade), ("x", {"stream": "btc@bookTicker", "data": {"s": "btc", "b": "1"}}),
        ("x", {**trade, "p": "much"}), ("x", {**book, "B": "NaN"}), ("x", {"e": "kline"}), ("x", "[1]"), ("x", "{broken"), ("x", None), ("x", {"stream": "btc@bookTicker", "data": 3}),
    ).drop("symbol")).cache()
    assert told(rows, "kind") == {("quote", "ok"): 2, ("trade", "ok"): 2, ("quote", "malformed quote"): 2, ("trade", "malformed trade"): 1, (None, "other"): 1, (None, "not an object"): 3, ("quote", "not an object"): 1}
    good = payloads.fine(rows).orderBy("seq").collect()
    assert [(r["symbol"], r["bid"], r["bid_qty"], r["ask"], r["ask_qty"]) for r in good[:2]] == [("BTC", 1.5, 2.0, 1.6, 3.0)] * 2
    assert [(r["symbol"], r["price"], r["qty"], r["buyer_is_maker"], r["bid"]) for r in good[2:]] == [("ETH", 10.0, 0.5, True, None)] * 2


def test_klines(spark):
    row = lambda t, c="2": [t, "1", "3", "0.5", c, "10", t + 999, "20", 7, "4", "8", "0"]
    rows = payloads.klines(landed(spark, ("A", [row(1000), row(2000)]), ("A", [row(2000, "9"), row(3000), [4000, "1"], row(5000, "x")]), ("B", [row(1000)]), ("B", []), ("B", "oops")))
    assert told(rows, "symbol") == {("A", "ok"): 3, ("A", "malformed row"): 2, ("B", "ok"): 1, ("B", "no rows"): 2}
    got = payloads.fine(rows).orderBy("symbol", "open_ms").collect()
    assert [tuple(r) for r in got[:2]] == [("A", 1000, 1.0, 3.0, 0.5, 2.0, 10.0, 4.0), ("A", 2000, 1.0, 3.0, 0.5, 2.0, 10.0, 4.0)]


def test_news(spark):
    items = [{"id": "7", "created_at": "2024-01-02T03:04:05Z", "headline": "\t Up \n", "symbols": ["aapl", "Msft"], "summary": " s "}, {"id": "x", "created_at": "2024-01-02T00:00:00Z", "headline": "h"}, {"id": 1, "headline": "h"}, {"id": 2, "created_at": "2024-01-02T00:00:00+02:00", "headline": "  "}, 5, {"id": 3, "created_at": "2024-01-02T00:00:00+02:00", "headline": "fine"}]
    rows = payloads.news(landed(spark, ("x", {"news": items}), ("x", {"news": []}), ("x", {})))
    assert told(rows) == {("ok",): 2, ("no id",): 2, ("no time",): 1, ("no headline",): 1, ("no news",): 2}
    a, b = payloads.fine(rows).orderBy(F.desc("id")).collect()
    assert tuple(a) == (7, dt.datetime(2024, 1, 2, 3, 4, 5), "Up", ["AAPL", "MSFT"], "", "", "s") and b["created_at"] == dt.datetime(2024, 1, 1, 22) and b["symbols"] == []


def test_chart(spark):
    quote = {"open": [1.0, 2.0, None, 0.0, 4.0], "high": [0.9, 2.5, 3.0, 3.0, 4.0], "low": [1.2, 1.9, 3.0, 3.0, 4.0], "close": [1.1, 2.2, 3.0, 3.0, 4.5], "volume": [None, 5, 6, 7, 8]}
    one = {"chart": {"result": [{"timestamp": [60, 120, 180, 240, 60], "indicators": {"quote": [quote]}}]}}
    rows = payloads.chart(landed(spark, ("A", one), ("B", {"chart": {"result": [{"indicators": {"quote": [{}]}}]}}), ("C", {"chart": {"result": None}})))
    assert told(rows, "symbol") == {("A", "ok"): 2, ("A", "no price"): 2, ("B", "no bars"): 1, ("C", "no bars"): 1}
    got = payloads.fine(rows).orderBy("ts").collect()
    assert [tuple(r)[2:] for r in got] == [(4.0, 4.5, 4.0, 4.5, 8.0), (2.0, 2.5, 1.9, 2.2, 5.0)]


def test_daily_vendor(spark):
    rows = spark.createDataFrame(
        [("A", "2024-01-02 00:00:00-05:00", 1.0, 0.9, 1.2, 1.1, None, 0), ("A", "2024-01-03 00:00:00-05:00", 1.0, 2.0, 1.0, 1.0, -5.0, 1), ("A", "2024-01-03 23:00:00-05:00", 2.0, 2.0, 2.0, 2.0, 7.0, 2), ("A", "2024-01-04", 1.0, None, 1.0, 1.0, 1.0, 3), ("A", "2024-01-05", 1.0, 1.0, -1.0, 1.0, 1.0, 4), ("A", "soon", 1.0, 1.0, 1.0, 1.0, 1.0, 5), ("A", "2024-01-06", 1.0, 1.0, 1.0, math.nan, 1.0, 6)],
        "Symbol string, At string, Open double, HIGH double, Low double, Close double, Volume double, Seq long",
    )
    out = payloads.daily_vendor(rows, "seq")
    assert told(out) == {("ok",): 2, ("no price",): 3, ("no time",): 1}
    assert [tuple(r) for r in payloads.fine(out).orderBy("ts").collect()] == [("A", T0, 1.0, 1.2, 0.9, 1.1, 0.0), ("A", dt.datetime(2024, 1, 3), 2.0, 2.0, 2.0, 2.0, 7.0)]


def test_symbol_info_and_days(spark):
    info = {"symbols": [
        {"symbol": "AB", "baseAsset": "A", "quoteAsset": "B", "filters": [{"filterType": "LOT_SIZE", "stepSize": "0.1"}, {"filterType": "MIN_NOTIONAL", "minNotional": "5"}, {"filterType": "NOTIONAL", "minNotional": "10", "applyToMarket": True}]},
        {"symbol": "CD", "filters": [{"filterType": "LOT_SIZE", "stepSize": "1"}, {"filterType": "LOT_SIZE", "stepSize": "2"}, {"filterType": "MIN_NOTIONAL", "minNotional": "5"}]}, {"symbol": "EF"}, {"baseAsset": "none"},
    ]}
    tickers = spark.createDataFrame([("AB", "12.5"), ("ZZ", "1")], "symbol string, volume string")
    got = {tuple(r) for r in payloads.symbol_info(landed(spark, ("x", info)), tickers).collect()}
    assert got == {("AB", "A", "B", 0.1, 10.0, 12.5), ("CD", "", "", 2.0, 5.0, 0.0), ("EF", "", "", 1e-8, 0.0, 0.0)}
    days = payloads.trading_days(landed(spark, ("x", [{"date": "2024-01-02", "open": "09:30"}, {"date": "2024-01-02"}, {"date": "2024-13-02"}, {"day": 1}]), ("x", "no")))
    assert {(str(r["day"]), r["problem"]) for r in days.collect()} == {("2024-01-02", None), ("None", "no date")}


def test_universe():
    named = {"pair": ["A", "B"]}
    assert payloads.universe("pair", named) == ["A", "B"] and payloads.universe(" X, ,Y", named) == ["X", "Y"] and payloads.universe("new", named) == ["new"]
    with pytest.raises(ValueError):
        payloads.universe(" , ", named)


def test_report_rows(spark):
    rows = spark.createDataFrame([(1, math.inf, [1.0, math.nan], {"a": -math.inf, "b": 2.0}, (math.nan, None), "x")], "n int, v double, l array<double>, m map<string,double>, s struct<p:double,q:string>, t string")
    assert [json.loads(r["value"]) for r in payloads.report_rows(rows).collect()] == [{"n": 1, "v": None, "l": [1.0, None], "m": {"a": None, "b": 2.0}, "s": {"p": None, "q": None}, "t": "x"}]


def bars(spark, *rows):
    return spark.createDataFrame([(s, tf, T0 + dt.timedelta(days=d), o, h, low, c, 1.0) for s, tf, d, o, h, low, c in rows], bar_files.STORED)


def test_bar_store(spark, tmp_path):
    root = str(tmp_path / "bars")
    assert bar_files.stored_symbols(spark, root, "1d").count() == 0
    bar_files.write_bars(bars(spark, *(("A", "1d", d, 1.0, 2.0, 0.5, 1.5) for d in range(5)), ("B", "1d", 0, 1.0, 2.0, 0.5, 1.5), ("A", "1h", 0, 1.0, 2.0, 0.5, 1.5)), root)
    assert {r["symbol"] for r in bar_files.stored_symbols(spark, root, "1d").collect()} == {"A", "B"}
    got = bar_files.read_bars(spark, root, "1d", ["A"], T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=3))
    assert sorted(r["ts"].day for r in got.collect()) == [3, 4, 5]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(timeframe" in plan and "symbol" in plan.split("PartitionFilters")[1].split("]")[0]
    # A second write replaces its own series and no other.
    bar_files.write_bars(bars(spark, ("A", "1d", 9, 1.0, 2.0, 0.5, 1.5)), root)
    assert bar_files.read_bars(spark, root, "1d", ["A"]).count() == 1 and bar_files.read_bars(spark, root, "1d", ["B"]).count() == 1 and bar_files.read_bars(spark, root, "1h", ["A"]).count() == 1
    with pytest.raises(FileNotFoundError, match="1d: C, D"):
        bar_files.read_bars(spark, root, "1d", ["D", "A", "C"])
    for bad, rule in ((("A", "1d", 0, 1.0, 0.5, 0.4, 1.5), "high_too_low"), (("A", "1d", 0, 0.0, 2.0, 0.0, 1.5), "not_positive"), (("A", "1d", 0, 1.0, 2.0, 1.2, 1.5), "low_too_high")):
        with pytest.raises(ValueError, match=rule):
            bar_files.write_bars(bars(spark, ("A", "1d", 1, 1.0, 2.0, 0.5, 1.5), bad), root)
    with pytest.raises(ValueError, match="repeated_time"):
        bar_files.write_bars(bars(spark, *[("A", "1d", 0, 1.0, 2.0, 0.5, 1.5)] * 2), root)
    assert bar_files.read_bars(spark, root, "1d", ["A"]).count() == 1


def test_csv(spark, tmp_path):
    (tmp_path / "BTC_1h.csv").write_text("﻿Timestamp,Open,High,Low,Close,Volume\n2024-01-02 01:00:00,1,2,0.5,1.5,10\n2024-01-02T02:00:00+01:00,1,2,0.5,x,10\n\n")
    (tmp_path / "A_B_1d.csv").write_text('"volume","close","note","low","high","open","Date"\n"7","1.5","n","0.5","2","1","2024-01-02"\n7,1.5,n,0.5,2,1,later\n7,1.5\n')
    (tmp_path / "bare_1d.csv").write_text("1,2,3\n")
    rows = bar_files.read_csv(spark, str(tmp_path / "*.csv")).cache()
    assert told(rows, "symbol", "timeframe") == {("BTC", "1h", "ok"): 1, ("BTC", "1h", "no number"): 1, ("A_B", "1d", "ok"): 1, ("A_B", "1d", "no time"): 2, ("bare", "1d", "no header"): 1}
    assert {tuple(r) for r in payloads.fine(rows).collect()} == {("BTC", "1h", dt.datetime(2024, 1, 2, 1), 1.0, 2.0, 0.5, 1.5, 10.0), ("A_B", "1d", T0, 1.0, 2.0, 0.5, 1.5, 7.0)}


def test_a_dense_day_comes_in_pages(spark):
    from marketlab import queries_sources

    t = spark.range(3500).select(F.lit("A").alias("symbol"), F.lit(T0).cast("timestamp").alias("ts"), F.col("id").alias("seq"))
    pages = queries_sources._by_day(t, F.col("seq").cast("string")).orderBy("seq").collect()
    assert [len(p["parts"]) for p in pages] == [1000, 1000, 1000, 500] and [x for p in pages for x in p["parts"]] == [str(i) for i in range(3500)]
