"""Registered queries of the desk: rules that change while a stream runs, and the gate before real money."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marketlab.operators import features, golive
from marketlab.operators.scan import smooth
from marketlab.plans.conditions import Exit, Spec, all_of
from marketlab.queries import query
from marketlab.queries_studies import SQL_STUDY, _p_sql
from marketlab.sources import books, views
from marketlab.sources.books import SQL_OPS, SQL_TRIPS
from marketlab.sources.store import shared_path
from marketlab.streaming import hot_rules
from marketlab.streaming.bars import drain

DAY_S = 86_400

# --- rules on a stream

#: Up after down on volume, out when volume dries up.
TURN = Spec("turn", "turn", all_of(("close", "crosses_above", "open"), ("volume_ratio", ">", "$vol_th")), Exit("$stop_atr", 3.0, None, None, 15, all_of(("volume_ratio", "<", 0.3))), {"vol_th": 1.2, "stop_atr": 0.5})
#: strategy, symbol, volume threshold, stop in ATRs, added, removed (null: never).
DESK = (("pooled", "*", 1.2, 0.5, dt.date(1995, 3, 1), dt.date(1998, 1, 1)), ("wide", "NO", 1.0, 1.0, dt.date(1999, 6, 1), None), ("narrow", "*", 1.5, 0.25, dt.date(1996, 3, 1), dt.date(1999, 9, 1)))
HALF = dt.date(1997, 7, 1)
SQL_DESK = "hr(strategy, own, vol_th, stop_atr, from_ts, until_ts) AS (VALUES " + ", ".join(f"('{s}', '{own}', CAST({v} AS DOUBLE), CAST({stop} AS DOUBLE), TIMESTAMP '{a} 00:00:00', {f"TIMESTAMP '{b} 00:00:00'" if b else 'CAST(NULL AS TIMESTAMP)'})" for s, own, v, stop, a, b in DESK) + ")"


def _desk_log(spark: SparkSession, known_until: dt.date) -> DataFrame:
    """Changes of the rules that were made by then."""
    rows = []
    for strategy, symbol, vol_th, stop_atr, *changes in DESK:
        for action, day in zip(("add", "remove"), changes):
            if day and day < known_until:
                rows.append((strategy, symbol, json.dumps(TURN.render({"vol_th": vol_th, "stop_atr": stop_atr}).data()), action, dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc), len(rows)))
    return spark.createDataFrame(rows, hot_rules.LOG)


@query(f"""WITH RECURSIVE {SQL_STUDY}, {SQL_DESK}, hx AS MATERIALIZED (SELECT *, lag(close - open) OVER s AS pg, lag(vr) OVER s AS pvr FROM x WINDOW s AS (PARTITION BY symbol ORDER BY i)),
  h0 AS MATERIALIZED (SELECT strategy, until_ts, symbol, last_i, ts AS signal_ts, i + 1 AS entry_i, next_ts AS entry_ts, next_open AS entry_price, next_open - stop_atr * a AS stop, next_open + 3 * a AS target FROM hx JOIN hr ON own IN ('*', symbol)
    WHERE pg <= 0 AND close > open AND vr > vol_th AND i >= 14 AND next_open IS NOT NULL AND ts + INTERVAL 1 DAY >= from_ts AND (until_ts IS NULL OR ts + INTERVAL 1 DAY < until_ts)),
  h1 AS (SELECT h0.*, v.i, v.ts AS bar_ts, CASE WHEN v.i > entry_i AND pvr < CAST(0.3 AS DOUBLE) THEN row('signal', v.open) WHEN v.i - entry_i >= 15 THEN row('max_holding', v.open) WHEN v.low <= stop THEN row('stop', CASE WHEN v.i = entry_i THEN stop ELSE least(v.open, stop) END)
    WHEN v.high >= target THEN row('target', CASE WHEN v.i = entry_i THEN target ELSE greatest(v.open, target) END) WHEN v.i = h0.last_i THEN row('end_of_data', v.close) END AS fin FROM h0 JOIN hx AS v ON v.symbol = h0.symbol AND v.i BETWEEN entry_i AND entry_i + 15),
  hc AS MATERIALIZED (SELECT strategy, until_ts, symbol, signal_ts, entry_i, entry_ts, entry_price, min(i) AS exit_i, arg_min(fin, i) AS ended, arg_min(bar_ts, i) AS exit_ts FROM h1 WHERE fin IS NOT NULL GROUP BY ALL),
  hn AS MATERIALIZED (SELECT l.symbol, l.strategy, l.entry_i, r.entry_i AS then_i FROM hc AS l ASOF LEFT JOIN hc AS r ON l.symbol = r.symbol AND l.strategy = r.strategy AND l.exit_i < r.entry_i),
  hw AS (SELECT symbol, strategy, min(entry_i) AS entry_i FROM hc GROUP BY 1, 2 UNION ALL SELECT hn.symbol, hn.strategy, hn.then_i FROM hw JOIN hn ON hn.symbol = hw.symbol AND hn.strategy = hw.strategy AND hn.entry_i = hw.entry_i WHERE hn.then_i IS NOT NULL)
  SELECT strategy, symbol, CAST(CAST(signal_ts AS DATE) AS VARCHAR) AS signal_day, CAST(CAST(entry_ts AS DATE) AS VARCHAR) AS entry_day, CAST(CAST(exit_ts AS DATE) AS VARCHAR) AS exit_day, round(entry_price, 6) AS entry_price, round(ended[2], 6) AS exit_price, ended[1] AS reason,
    coalesce(exit_ts >= until_ts, false) AS retired FROM hc JOIN hw USING (symbol, strategy, entry_i) WHERE ended[1] <> 'end_of_data'""")
def ss14_hot_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished trades of rules that came and went while two halves of the daily bars streamed in; the second half meets a longer log than the first."""
    b = features.volume_ratio(smooth(features.true_range(views.bars_1d(spark, sf_dir)), {"atr": ("true_range", 1 / 14, 14)}))
    b = b.select("symbol", "ts", "open", "high", "low", "close", "atr", "volume_ratio")
    base = shared_path(spark, "hot")
    crossing = sorted(TURN.entry.crossing())
    for inside, known_until in ((F.col("ts") < F.lit(HALF), HALF), (F.col("ts") >= F.lit(HALF), dt.date(9999, 1, 1))):
        b.where(inside).repartitionByRange("ts").write.mode("append").parquet(f"{base}/bars")
        stream = hot_rules.with_before(spark.readStream.schema(b.schema).parquet(f"{base}/bars"), crossing)
        hot_rules.decided(stream, lambda s, k=known_until: _desk_log(s, k), DAY_S, f"{base}/decided").awaitTermination()
    t = drain(hot_rules.rule_trades(hot_rules.decided_stream(spark, f"{base}/decided")), "hot-trades")
    t = hot_rules.with_retirement(t, hot_rules.rule_spans(_desk_log(spark, dt.date(9999, 1, 1))), DAY_S)
    day = lambda c: F.to_date(f"{c}_ts").cast("string").alias(f"{c}_day")
    return t.select("strategy", "symbol", day("signal"), day("entry"), day("exit"), F.round("entry_price", 6).alias("entry_price"), F.round("exit_price", 6).alias("exit_price"), "reason", "retired")


# --- the gate

GATE = golive.Gate(session_gap_s=2 * DAY_S)
SQL_GATE = f"""{SQL_TRIPS}, {SQL_OPS}, gt AS (SELECT run_id || '/' || strategy[1:1] AS run_id, exit_ts, entry_ts, book, net_return, pnl, o_totalprice FROM rt), gr AS (SELECT run_id, max(exit_ts) + INTERVAL 1 SECOND AS now, CASE WHEN run_id[4:4] = '1' THEN 0.0002 ELSE 0.2 END AS max_drawdown, run_id[4:4] <> '2' AS external FROM gt GROUP BY 1),
  gv AS (SELECT r.run_id, e.ts - INTERVAL 6 YEAR AS ts, e.seq, e.kind FROM oe AS e JOIN gr AS r ON r.run_id[1:4] = e.run_id AND (e.kind <> 'reconciliation_mismatch' OR e.seq % 5 = CAST(r.run_id[6:6] AS BIGINT))),
  gd AS (SELECT run_id, entry_ts AS ts, sum(pnl) AS p, avg(o_totalprice) AS m FROM gt GROUP BY 1, 2), ge AS (SELECT run_id, ts, 1e6 + sum(p) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity, 1e6 + m / 15 AS buy_hold FROM gd),
  gl AS (SELECT *, lag(ts) OVER w AS pt, lag(equity) OVER w AS pe, lag(buy_hold) OVER w AS pb FROM ge WINDOW w AS (PARTITION BY run_id ORDER BY ts)), gs AS (SELECT run_id, ts FROM gv WHERE kind = 'session_start'),
  gf AS (SELECT run_id, ts, equity / pe AS ef, buy_hold / pb AS bf FROM gl WHERE pt IS NOT NULL AND epoch_us(ts) - epoch_us(pt) <= 172800000000 AND NOT EXISTS (SELECT 1 FROM gs WHERE gs.run_id = gl.run_id AND gs.ts > gl.pt AND gs.ts <= gl.ts)),
  gp AS (SELECT *, sum(ln(ef)) OVER w AS l FROM gf WINDOW w AS (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING)), gq AS (SELECT *, greatest(0, max(l) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS pk FROM gp),
  gg AS (SELECT run_id, count(*) AS steps, exp(sum(ln(ef))) - 1 AS strategy, exp(sum(ln(bf))) - 1 AS benchmark, max(1 - exp(l - pk)) AS drawdown FROM gq GROUP BY 1),
  gn AS (SELECT run_id, count(*) AS n, avg(net_return) AS mean, stddev_samp(net_return) AS sd, sum(pnl) AS net FROM gt WHERE book = 'paper' GROUP BY 1),
  gw AS (SELECT run_id, CAST(count(*) FILTER (p > 0) AS DOUBLE) AS positive FROM (SELECT run_id, floor((epoch_us(now) - epoch_us(exit_ts) - 1) / 604800000000.0) AS week, sum(pnl) AS p FROM gt JOIN gr USING (run_id) WHERE book = 'paper' GROUP BY 1, 2) WHERE week < 4 GROUP BY 1),
  gm AS (SELECT run_id, count(*) FILTER (kind = 'reconciliation_mismatch') AS mismatches, coalesce(min(CASE WHEN kind = 'kill_switch_on' THEN row(ts, seq) END) < max(CASE WHEN kind = 'kill_switch_off' THEN row(ts, seq) END), false) AS tested FROM gv GROUP BY 1),
  ga AS (SELECT gr.*, (epoch_us(now) - epoch_us((SELECT min(ts) FROM ge WHERE ge.run_id = gr.run_id))) / 86400000000.0 AS days, coalesce(n, 0) AS n, coalesce(net, 0) AS net, CASE WHEN n >= 3 AND sd > 0 THEN {_p_sql()} ELSE 1 END AS p, coalesce(positive, 0) AS positive, coalesce(steps, 0) AS steps, strategy, benchmark, drawdown,
    coalesce(mismatches, 0) AS mismatches, coalesce(tested, false) AS tested FROM gr LEFT JOIN gn USING (run_id) LEFT JOIN gw USING (run_id) LEFT JOIN gg USING (run_id) LEFT JOIN gm USING (run_id)),
  gc AS (SELECT run_id, unnest([row('days', days >= 28, days, 28, days / 28), row('trades', n >= 50, n, 50, n / CAST(50 AS DOUBLE)), row('net', n > 0 AND net > 0, net, 0, 0), row('edge', p < 0.05, p, 0.05, (1 - p) / CAST(0.95 AS DOUBLE)),
      row('consistency', days >= 28 AND positive >= 3, positive, 3, least(positive, floor(days / 7)) / 3), row('buy_hold', steps > 0 AND strategy > benchmark, strategy, benchmark, 0), row('drawdown', steps > 0 AND drawdown <= max_drawdown, drawdown, max_drawdown, CASE WHEN drawdown > 0 THEN max_drawdown / drawdown ELSE 0 END),
      row('venue', external, CAST(external AS DOUBLE), 1, 0), row('reconciliation', external AND mismatches = 0, mismatches, 0, 0), row('kill_switch', tested, CAST(tested AS DOUBLE), 1, 0)]) AS c FROM ga),
  gz AS (SELECT run_id, c[1] AS criterion, coalesce(c[2], false) AS ok, CAST(c[3] AS DOUBLE) AS value, CAST(c[4] AS DOUBLE) AS target, CASE WHEN c[2] THEN 1.0 ELSE greatest(0, least(0.99, coalesce(CAST(c[5] AS DOUBLE), 0))) END AS progress FROM gc)"""


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The criteria of fifteen runs: three, each by the first letter of its strategies."""
    c = F.col
    t = books.round_trips(spark, sf_dir).withColumn("run_id", F.concat("run_id", F.lit("/"), F.substring("strategy", 1, 1)))
    prices = views.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("seq"), "o_totalprice")
    days = t.join(prices, "seq").groupBy("run_id", c("entry_ts").alias("ts")).agg(F.sum("pnl").alias("_p"), F.avg("o_totalprice").alias("_m"))
    equity = days.select("run_id", "ts", (F.lit(1e6) + F.sum("_p").over(W.partitionBy("run_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0))).alias("equity"), (F.lit(1e6) + c("_m") / 15).alias("buy_hold"))
    kind = F.substring("run_id", 4, 1)
    runs = t.groupBy("run_id").agg((F.max("exit_ts") + F.expr("interval 1 second")).alias("now")).select("run_id", "now", F.when(kind == "1", 0.0002).otherwise(0.2).alias("max_drawdown"), (kind != "2").alias("external"))
    e = books.ops_events(spark, sf_dir).withColumnRenamed("run_id", "_of")
    own = (F.substring("run_id", 1, 4) == c("_of")) & ((c("kind") != "reconciliation_mismatch") | (c("seq") % 5 == F.substring("run_id", 6, 1).cast("int")))
    events = e.join(F.broadcast(runs.select("run_id")), own).select("run_id", F.expr("ts - interval 6 years").alias("ts"), "seq", "kind")
    return golive.criteria(golive.figures(runs, equity, t, events, GATE), GATE)


@query(f"WITH {SQL_GATE} SELECT run_id, criterion, ok, round(value, 6) AS value, round(target, 6) AS target, round(progress, 6) AS progress FROM gz")
def ev5_gate_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every criterion of every run, with how near it is."""
    return _gate(spark, sf_dir).select("run_id", "criterion", "ok", *(F.round(c, 6).alias(c) for c in ("value", "target", "progress")))


@query(f"WITH {SQL_GATE} SELECT run_id, count(*) FILTER (ok) AS passed, count(*) AS total, round(avg(progress), 6) AS progress, count(*) FILTER (ok) = count(*) AS ready FROM gz GROUP BY 1")
def ev5_gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a run ready, and how far has it come?"""
    return golive.verdict(_gate(spark, sf_dir)).select("run_id", "passed", "total", F.round("progress", 6).alias("progress"), "ready")
