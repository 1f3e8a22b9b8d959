"""Book-shaped views of the given tables: round trips, equity, operational events, rule logs, runs, and orders to screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marketlab.operators import desk
from marketlab.sources.views import table


def round_trips(spark: SparkSession, sf_dir: str, **also: Column) -> DataFrame:
    """seq, strategy, symbol, book, run_id, entry_ts, exit_ts, net_return, pnl: a trip for each order; also: further columns, of the order's own."""
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    net = (F.round(F.col("o_totalprice") * 100).cast("long") % 2001 - 990) / 10000
    return o.select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("strategy"), F.col("o_orderstatus").alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, "paper").otherwise("shadow").alias("book"), F.concat(F.lit("run"), F.col("o_custkey") % 3).alias("run_id"),
        at.alias("entry_ts"), F.timestamp_seconds(F.unix_timestamp(at) + (F.col("o_orderkey") % 7 + 1) * 3600).alias("exit_ts"), net.alias("net_return"), (net * 1000).alias("pnl"),
        *(c.alias(n) for n, c in also.items()),
    )


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, ts, equity, buy_hold: a sample a day on which orders came, from the pnl so far."""
    trips = round_trips(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), "o_totalprice"), "seq")
    days = trips.groupBy("run_id", F.col("entry_ts").alias("ts")).agg(F.sum("pnl").alias("_p"), F.avg("o_totalprice").alias("_m"))
    return days.select("run_id", "ts", (F.lit(1e6) + F.sum("_p").over(W.partitionBy("run_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0))).alias("equity"), (F.col("_m") / 15).alias("buy_hold"))


def ops_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, ts, seq, kind."""
    n = F.col("event_id") % 97
    kind = F.when(n == 0, "session_start").when(n == 1, "kill_switch_on").when(n == 2, "kill_switch_off").when(n == 3, "reconciliation_mismatch").otherwise("sample")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("run"), F.col("user_id") % 3).alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"))


def rule_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule, ts, seq, status: an append-only log."""
    status = F.when(F.col("o_orderstatus") == "F", "champion").when(F.col("o_orderstatus") == "O", "challenger").otherwise("retired")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("rule"), F.col("o_custkey") % 40).alias("rule"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("seq"), status.alias("status"))


def screening_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the figures of their market, portfolio, evidence and profile."""
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    bid = F.col("o_totalprice") / 1000
    ask = bid * (1 + (k % 8) * 0.0005)
    equity_ = F.lit(10000.0) + c
    rows = o.select(
        k.alias("seq"), F.when(k % 5 == 0, "sell").otherwise("buy").alias("side"), F.col("o_orderstatus").alias("symbol"), F.when(k % 101 == 0, "X").otherwise(F.col("o_orderstatus")).alias("market_symbol"), F.col("o_orderpriority").alias("strategy"),
        F.when(k % 13 != 0, F.when(k % 29 == 0, "other").otherwise(F.col("o_orderpriority"))).alias("evidence_strategy"), (k % 211 == 0).alias("kill_switch"), (k % 199 != 0).alias("api_healthy"), (k % 197 != 0).alias("reconciled"), (k % 1000).cast("double").alias("data_age"),
        (k % 17 != 0).alias("market_open"), F.array(F.lit("k1")).alias("pending"), F.when(k % 89 == 0, "k1").otherwise("k2").alias("order_key"), bid.alias("bid"), ask.alias("ask"), ask.alias("entry_price"), (ask * (1 - (k % 9) * 0.01)).alias("stop"),
        F.when(k % 3 == 0, 2.0).otherwise(0.0).alias("held"), bid.alias("held_price"), ((c % 60 - 10) / 1000).alias("daily_pnl"), (-(c % 12) / 100).alias("drawdown"), (c % 6).alias("consecutive_losses"), (c % 5).alias("open_positions"), ((k % 6) * 0.0005).alias("slippage"),
        ((c % 50) * 1000.0).alias("adv"), (k % 100).cast("double").alias("edge_score"), (0.75 + 0.25 * (c % 11) / 10).alias("confidence"), ((k % 40) / 1000).alias("gross_edge"), F.lit(0.003).alias("fees"), equity_.alias("equity"), (equity_ * (c % 8) / 10).alias("positions_value"),
        (equity_ * (10 - c % 8) / 10).alias("cash"), (0.5 + (c % 5) / 20).alias("p_win"), F.lit(0.03).alias("avg_win"), (0.01 + (k % 4) / 100).alias("avg_loss"), ((c % 5) * 25).alias("level"), F.lit(0.01).alias("step"),
    )
    return rows.withColumns(desk.profile(F.col("level")))


SQL_TRIPS = """rt AS (SELECT o_orderkey AS seq, o_orderpriority AS strategy, o_orderstatus AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'paper' ELSE 'shadow' END AS book, 'run' || (o_custkey % 3) AS run_id, CAST(o_orderdate AS TIMESTAMP) AS entry_ts,
    CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey % 7 + 1) AS exit_ts, (CAST(round(o_totalprice * 100) AS BIGINT) % 2001 - 990) / CAST(10000 AS DOUBLE) AS net_return, (CAST(round(o_totalprice * 100) AS BIGINT) % 2001 - 990) / CAST(10000 AS DOUBLE) * 1000 AS pnl, o_totalprice FROM orders)"""
SQL_EQUITY = SQL_TRIPS + """, ed AS (SELECT run_id, entry_ts AS ts, sum(pnl) AS p, avg(o_totalprice) AS m FROM rt GROUP BY 1, 2), eq AS (SELECT run_id, ts, 1e6 + sum(p) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity, m / 15 AS buy_hold FROM ed)"""
SQL_OPS = """oe AS (SELECT 'run' || (user_id % 3) AS run_id, CAST(ts AS TIMESTAMP) AS ts, event_id AS seq, CASE event_id % 97 WHEN 0 THEN 'session_start' WHEN 1 THEN 'kill_switch_on' WHEN 2 THEN 'kill_switch_off' WHEN 3 THEN 'reconciliation_mismatch' ELSE 'sample' END AS kind FROM events)"""
SQL_RULES = """re AS (SELECT 'rule' || (o_custkey % 40) AS rule, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'champion' WHEN 'O' THEN 'challenger' ELSE 'retired' END AS status FROM orders)"""
