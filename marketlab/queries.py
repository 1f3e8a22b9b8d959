"""Registered queries over the market views of the given tables, and the same in SQL.

Keys begin with the item of the operator inventory that they cover.
"""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.functions import columns
from marketlab.operators import bars, features, joins, research, study, trades, validation
from marketlab.operators.scan import smooth
from marketlab.plans import rules
from marketlab.sources import views
from marketlab.sources.store import settled
from marketlab.streaming.bars import drain, stream_bars

#: The views of marketlab.sources.views in SQL.
SQL_TRADES = """tr AS (SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, value + 1 AS price, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) + 1 AS qty,
    event_id % 2 = 0 AS buyer_is_maker, event_id AS seq FROM events)"""
SQL_QUOTES = SQL_TRADES + """, qu AS (SELECT symbol, ts, price * 0.9995 AS bid, price * 1.0005 AS ask, seq FROM tr)"""
SQL_BARS = """li AS (SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts, CAST(l_extendedprice / l_quantity AS DOUBLE) AS price, CAST(l_quantity AS DOUBLE) AS qty,
    row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_quantity AS DOUBLE) ELSE 0 END AS taker FROM lineitem),
  b AS (SELECT symbol, ts, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(qty) AS volume, sum(taker) AS taker FROM li GROUP BY symbol, ts)"""
FRAMES = "WINDOW s AS (PARTITION BY symbol ORDER BY ts), " + ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)" for n in (5, 15, 20, 50, 200, 252)) + ", p20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
DAY = "CAST(CAST(ts AS DATE) AS VARCHAR) AS day"

_registered: dict[str, tuple] = {}


def query(sql: str | None = None):
    def register(f):
        _registered[f.__name__] = (f, sql)
        return f

    return register


def shown(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select("symbol", F.to_date("ts").cast("string").alias("day"), *(F.round(n, digits).alias(n) if dict(df.dtypes)[n] in ("double", "float") else F.col(n) for n in names))


def sql_features(exprs: dict[str, str], source: str = "b", more: str = "") -> str:
    cols = ", ".join(f"round({e}, 6) AS {n}" for n, e in exprs.items())
    return f"WITH {SQL_BARS}{more} SELECT symbol, {DAY}, {cols} FROM {source} {FRAMES}"


def full(expr: str, of: str, n: int) -> str:
    return f"CASE WHEN count({of}) OVER w{n} = {n} THEN {expr} END"


RETURNS = {f"ret_{n}": f"close / lag(close, {n}) OVER s - 1" for n in (1, 3, 5, 10, 20)}


@query(sql_features(RETURNS | {"momentum_20": RETURNS["ret_20"], "log_ret": "ln(close / lag(close) OVER s)"}))
def wn1_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(features.returns(views.bars_1d(spark, sf_dir)), *RETURNS, "momentum_20", "log_ret")


@query(sql_features({"volatility": full("stddev_samp(log_ret) OVER w20", "log_ret", 20)}, "r", ", r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS log_ret FROM b)"))
def wn3_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(features.volatility(features.returns(views.bars_1d(spark, sf_dir))), "volatility")


@query(sql_features({f"sma_{n}": full(f"avg(close) OVER w{n}", "close", n) for n in (20, 50, 200)} | {f"dist_sma_{n}": full(f"close / avg(close) OVER w{n} - 1", "close", n) for n in (20, 50, 200)}))
def wn4_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(features.averages(views.bars_1d(spark, sf_dir)), *(f"{p}sma_{n}" for p in ("", "dist_") for n in (20, 50, 200)))


@query(f"""WITH RECURSIVE {SQL_BARS}, n AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM b),
  e AS (SELECT symbol, ts, i, close AS y FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.ts, n.i, e.y * (19.0 / 21) + n.close * (2.0 / 21) FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)
  SELECT symbol, {DAY}, round(CASE WHEN i >= 20 THEN y END, 6) AS ema_20 FROM e""")
def wn5_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(smooth(views.bars_1d(spark, sf_dir), {"ema_20": ("close", 2 / 21, 20)}), "ema_20")


@query(f"""WITH RECURSIVE {SQL_BARS}, n AS (SELECT *, row_number() OVER s AS i, greatest(high - low, coalesce(abs(high - lag(close) OVER s), 0), coalesce(abs(low - lag(close) OVER s), 0)) AS tr,
    close - lag(close) OVER s AS d FROM b WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
  e AS (SELECT symbol, ts, i, tr AS a, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l FROM n WHERE i = 1 UNION ALL
    SELECT n.symbol, n.ts, n.i, e.a * (13.0 / 14) + n.tr / 14.0, coalesce(e.g * (13.0 / 14) + greatest(n.d, 0) / 14.0, greatest(n.d, 0)), coalesce(e.l * (13.0 / 14) + greatest(-n.d, 0) / 14.0, greatest(-n.d, 0)) FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)
  SELECT symbol, {DAY}, round(CASE WHEN i >= 14 THEN a END, 6) AS atr, round(CASE WHEN i >= 15 THEN CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 ELSE 50 END END, 6) AS rsi FROM e""")
def wn6_atr_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(features.smoothed(views.bars_1d(spark, sf_dir)), "atr", "rsi")


@query(sql_features({"bb_position": full("(close - (avg(close) OVER w20 - 2 * stddev_samp(close) OVER w20)) / nullif(4 * stddev_samp(close) OVER w20, 0)", "close", 20)}))
def wn9_bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(features.bollinger(views.bars_1d(spark, sf_dir)), "bb_position")


@query(sql_features({"volume_ratio": "CASE WHEN count(volume) OVER p20 = 20 THEN volume / nullif(avg(volume) OVER p20, 0) END"}))
def wn10_volume_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(features.volume_ratio(views.bars_1d(spark, sf_dir)), "volume_ratio")


@query(sql_features({"vwap_dev": full("close / (sum((high + low + close) / 3 * volume) OVER w20 / nullif(sum(volume) OVER w20, 0)) - 1", "volume", 20), "gap": "open / lag(close) OVER s - 1", "drawdown": "close / max(close) OVER w252 - 1"}))
def wn11_vwap_gap_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(features.drawdown(features.gap(features.vwap_deviation(views.bars_1d(spark, sf_dir)))), "vwap_dev", "gap", "drawdown")


@query(f"""WITH {SQL_BARS}, d AS (SELECT *, sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS step FROM b),
  g AS (SELECT *, sum(CASE WHEN step = -1 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ts) AS dg, sum(CASE WHEN step = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ts) AS ug FROM d)
  SELECT symbol, {DAY}, CAST(CASE WHEN step IS NOT NULL THEN sum(CASE WHEN step = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, dg ORDER BY ts) END AS BIGINT) AS down_streak,
    CAST(CASE WHEN step IS NOT NULL THEN sum(CASE WHEN step = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, ug ORDER BY ts) END AS BIGINT) AS up_streak FROM g""")
def wn13_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(features.streaks(views.bars_1d(spark, sf_dir)), "down_streak", "up_streak")


@query(sql_features({"high_20": full("max(high) OVER w20", "high", 20), "low_20": full("min(low) OVER w20", "low", 20), "dist_high_252": full("close / max(high) OVER w252 - 1", "high", 252)}))
def wn17_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(features.extremes(views.bars_1d(spark, sf_dir)), "high_20", "low_20", "dist_high_252")


@query(sql_features({f"flow_imbalance_{n}": full(f"sum(2 * taker - volume) OVER w{n} / nullif(sum(volume) OVER w{n}, 0)", "volume", n) for n in (5, 15)}))
def wn18_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(features.flow(views.bars_1d(spark, sf_dir)), "flow_imbalance_5", "flow_imbalance_15")


@query(f"""WITH {SQL_BARS}, y AS (SELECT *, close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM b), a AS (SELECT symbol, ts, r,
    CASE WHEN r IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY r NULLS LAST) + (count(*) OVER (PARTITION BY ts, r) - 1) / 2.0) / count(r) OVER (PARTITION BY ts) END AS k, r - median(r) OVER (PARTITION BY ts) AS rel FROM y),
  t AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS before, n FROM (SELECT ts, count(*) AS n FROM b GROUP BY ts))
  SELECT b.symbol, CAST(CAST(b.ts AS DATE) AS VARCHAR) AS day, p.n AS xs_n, round(a.k, 6) AS xs_rank_ret_20, round(a.rel, 6) AS xs_rel_ret_20
  FROM b JOIN t ON b.ts = t.ts LEFT JOIN t AS p ON p.ts = t.before LEFT JOIN a ON a.ts = t.before AND a.symbol = b.symbol""")
def wn21_cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(features.cross_section(views.bars_1d(spark, sf_dir)), "xs_n", "xs_rank_ret_20", "xs_rel_ret_20")


def _rank_sql(r: str) -> str:
    return f"CASE WHEN {r} IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY {r} NULLS LAST) + (count(*) OVER (PARTITION BY ts, {r}) - 1) / 2.0) / count({r}) OVER (PARTITION BY ts) END"


@query(f"""WITH RECURSIVE {SQL_BARS}, n AS (SELECT symbol, ts, close, row_number() OVER s AS i, close / lag(close, 5) OVER s - 1 AS r5, close / lag(close, 60) OVER s - 1 AS r60 FROM b WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
  e AS (SELECT symbol, ts, i, close AS y FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.ts, n.i, e.y * (49.0 / 51) + n.close * (2.0 / 51) FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1),
  a AS (SELECT symbol, ts, {_rank_sql("r5")} AS k5, {_rank_sql("r60")} AS k60 FROM n), p AS (SELECT n.ts, avg(CASE WHEN e.i >= 50 THEN CASE WHEN close > y THEN 1.0 ELSE 0 END END) AS breadth FROM n JOIN e ON e.symbol = n.symbol AND e.i = n.i GROUP BY 1), t AS (SELECT ts, breadth, lag(ts) OVER (ORDER BY ts) AS before FROM p)
  SELECT b.symbol, {DAY.replace("ts", "b.ts")}, round(a.k5, 6) AS xs_rank_ret_5, round(a.k60, 6) AS xs_rank_ret_60, round(q.breadth, 6) AS xs_breadth FROM b JOIN t ON b.ts = t.ts LEFT JOIN t AS q ON q.ts = t.before LEFT JOIN a ON a.ts = t.before AND a.symbol = b.symbol""")
def wn23_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of symbols above their own average, and the other two ranks (WN-21, WN-23)."""
    return shown(features.cross_section(views.bars_1d(spark, sf_dir)), "xs_rank_ret_5", "xs_rank_ret_60", "xs_breadth")


@query(sql_features({"body_range_ratio": "abs(close - open) / nullif(high - low, 0)", "upper_shadow": "(high - greatest(open, close)) / nullif(high - low, 0)", "lower_shadow": "(least(open, close) - low) / nullif(high - low, 0)", "close_position": "(close - low) / nullif(high - low, 0)"}))
def sc1_candle_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(features.candles(views.bars_1d(spark, sf_dir)), "body_range_ratio", "upper_shadow", "lower_shadow", "close_position")


@query(f"""WITH {SQL_BARS} SELECT symbol, {DAY}, CAST(dayofmonth(ts) AS INTEGER) AS day_of_month, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(date_diff('day', CAST(ts AS DATE), last_day(ts)) AS INTEGER) AS days_to_month_end FROM b""")
def sc5_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(views.bars_1d(spark, sf_dir).withColumns(columns.calendar(86400)), "day_of_month", "day_of_week", "days_to_month_end")


@query(f"""WITH {SQL_TRADES} SELECT symbol, CAST(date_trunc('hour', ts) AS VARCHAR) AS bar, round(arg_min(price, row(ts, seq)), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low,
  round(arg_max(price, row(ts, seq)), 6) AS close, round(sum(qty), 6) AS volume, round(sum(CASE WHEN buyer_is_maker THEN 0 ELSE qty END), 6) AS taker_buy_volume FROM tr GROUP BY 1, 2""")
def ag1_hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.bars_1h(spark, sf_dir)
    return b.select("symbol", F.col("ts").cast("string").alias("bar"), *(F.round(c, 6).alias(c) for c in ("open", "high", "low", "close", "volume", "taker_buy_volume")))


@query(f"""WITH {SQL_QUOTES}, f AS (SELECT symbol, min(ts) AS first_ts FROM qu GROUP BY 1), m AS (SELECT symbol, date_trunc('hour', ts) AS h, arg_min((bid + ask) / 2, row(ts, seq)) AS o, arg_max((bid + ask) / 2, row(ts, seq)) AS c FROM qu GROUP BY 1, 2),
  v AS (SELECT tr.symbol, date_trunc('hour', ts) AS h, count(*) AS n, sum(qty) AS q FROM tr JOIN f ON tr.symbol = f.symbol AND ts >= first_ts GROUP BY 1, 2)
  SELECT m.symbol, CAST(m.h AS VARCHAR) AS bar, round(o, 6) AS open, round(c, 6) AS close, round(coalesce(q, 0), 6) AS volume, coalesce(n, 0) AS n_trades FROM m LEFT JOIN v ON m.symbol = v.symbol AND m.h = v.h""")
def ag2_tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.tick_bars(views.quotes(spark, sf_dir), views.trades(spark, sf_dir), "1 hour")
    return b.select("symbol", F.col("ts").cast("string").alias("bar"), F.round("open", 6).alias("open"), F.round("close", 6).alias("close"), F.round("volume", 6).alias("volume"), "n_trades")


@query(f"""WITH {SQL_QUOTES} SELECT t.symbol, t.seq, round(q.ask, 6) AS ask FROM (SELECT symbol, ts + INTERVAL 60 SECOND AS ts, seq FROM tr) AS t ASOF LEFT JOIN (SELECT symbol, ts, ask FROM qu) AS q ON t.symbol = q.symbol AND t.ts <= q.ts""")
def jn1_forward_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ask of the first quote at least a minute after every trade."""
    signals = views.trades(spark, sf_dir).select("symbol", F.expr("ts + interval 60 seconds").alias("ts"), "seq")
    return joins.asof(signals, views.quotes(spark, sf_dir), "ask", forward=True).select("symbol", "seq", F.round("ask", 6).alias("ask"))


@query(f"""WITH {SQL_QUOTES} SELECT t.symbol, t.seq, round(q.bid, 6) AS bid FROM tr AS t ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 1 SECOND AS ts, bid FROM qu) AS q ON t.symbol = q.symbol AND t.ts >= q.ts""")
def jn2_backward_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bid known for at least a second when a trade comes, for every trade."""
    quotes = views.quotes(spark, sf_dir).withColumn("ts", F.expr("ts + interval 1 second"))
    return joins.asof(views.trades(spark, sf_dir).select("symbol", "ts", "seq"), quotes, "bid").select("symbol", "seq", F.round("bid", 6).alias("bid"))


@query(f"""WITH {SQL_TRADES}, h AS (SELECT symbol, date_trunc('hour', ts) AS ts FROM tr GROUP BY 1, 2), n AS (SELECT event_type AS symbol, CAST(e.ts AS TIMESTAMP) AS ts FROM documents JOIN events e ON doc_id = event_id)
  SELECT h.symbol, CAST(h.ts AS VARCHAR) AS bar, count(CASE WHEN n.ts > h.ts - INTERVAL 1 DAY THEN 1 END) AS n_1d, count(n.ts) AS n_20d FROM h LEFT JOIN n ON n.symbol = h.symbol AND n.ts <= h.ts AND n.ts > h.ts - INTERVAL 20 DAY GROUP BY 1, 2""")
def jn3_headline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = views.headlines(spark, sf_dir).select(F.explode("symbols").alias("symbol"), F.col("created_at").alias("ts"))
    return joins.range_counts(views.bars_1h(spark, sf_dir).select("symbol", "ts"), news, (1, 20)).select("symbol", F.col("ts").cast("string").alias("bar"), "n_1d", "n_20d")


@query(f"WITH {SQL_BARS} SELECT DISTINCT symbol FROM b")
def io3_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the daily bars, from their two columns; no bar is made."""
    return views.bar_symbols(spark, sf_dir)


@query(f"""WITH {SQL_BARS} SELECT 'high_below_body' AS rule, symbol, {DAY} FROM b WHERE high < greatest(open, close) UNION ALL SELECT 'low_above_body', symbol, {DAY} FROM b WHERE low > least(open, close)
  UNION ALL SELECT 'not_positive', symbol, {DAY} FROM b WHERE least(open, high, low, close) <= 0 UNION ALL SELECT 'negative_volume', symbol, {DAY} FROM b WHERE volume < 0""")
def io11_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.violations(views.bars_1d(spark, sf_dir)).select("rule", "symbol", F.to_date("ts").cast("string").alias("day"))


@query(f"""WITH {SQL_BARS}, n AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM b) SELECT symbol, {DAY}, CASE WHEN i <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'is' ELSE 'oos' END AS fold FROM n""")
def rs1_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(validation.chronological_split(views.bars_1d(spark, sf_dir)), "fold")


@query(f"""WITH {SQL_BARS}, n AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM b),
  f AS (SELECT *, floor(n * k / 5.0) AS lo, floor(n * (k + 1) / 5.0) AS hi FROM n CROSS JOIN range(5) AS r(k))
  SELECT symbol, {DAY}, CAST(k AS INTEGER) AS k, CASE WHEN i >= lo AND i < hi THEN 'test' ELSE 'train' END AS part FROM f WHERE (i >= lo AND i < hi) OR i < lo - 2 OR i >= hi + 2""")
def rs2_purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(validation.purged_folds(views.bars_1d(spark, sf_dir)), "k", "part")


@query("""WITH t AS (SELECT event_type AS family, event_id, (event_id * 7919 % 10007) / 10007.0 AS p FROM events), r AS (SELECT *, p * count(*) OVER (PARTITION BY family) / count(*) OVER (PARTITION BY family ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM t),
  a AS (SELECT *, least(1, min(raw) OVER (PARTITION BY family ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adj FROM r) SELECT family, event_id, round(adj, 6) AS p_adjusted, adj <= 0.05 AS rejected FROM a""")
def rs5_false_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("family"), "event_id", (F.col("event_id") * 7919 % 10007 / F.lit(10007.0)).alias("p"))
    found = study.global_discovery(tests, 0.05, "family")
    return found.select("family", "event_id", F.round("p_global", 6).alias("p_adjusted"), F.col("global_rejected").alias("rejected"))


@query("""WITH g AS (SELECT event_type AS family, count(*) FILTER (WHERE value > 100) AS w, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1), z AS (SELECT *, 1.959963984540054 AS z, w / n AS p FROM g)
  SELECT family, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n))), 6) AS low, round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n))), 6) AS high FROM z""")
def sc11_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("family")).agg(F.sum((F.col("value") > 100).cast("long")).alias("w"), F.count("*").alias("n"))
    low, high = columns.wilson(F.col("w"), F.col("n"))
    return g.select("family", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def _momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net trades of the momentum rule's grid on daily bars."""
    b = settled(features.range_and_strength(features.averages(features.returns(views.bars_1d(spark, sf_dir)), (200,))), "bars")
    grid = [(f"momentum[{m},{r},{s}]", m, float(r), s, 4.0, 20) for m in (0.03, 0.05, 0.08) for r in (70, 80) for s in (2.0, 3.0)] + [("momentum", 0.05, 75.0, 2.5, 4.0, 20)]
    variants = spark.createDataFrame(grid, "variant string, mom_th double, rsi_max double, stop_atr double, target_atr double, hold int")
    enter = (F.col("momentum_20") > F.col("mom_th")) & (F.col("close") > F.col("sma_200")) & (F.col("rsi") < F.col("rsi_max"))
    return trades.net_returns(trades.single_position(trades.candidates(b, variants, enter, F.lit(False))))


@query()
def ex1_momentum_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _momentum(spark, sf_dir)


@query()
def ag3_momentum_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.metrics(_momentum(spark, sf_dir), "symbol", "variant")


@query()
def wn19_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.regime(features.averages(features.volatility(features.returns(views.bars_1d(spark, sf_dir))), (200,)))
    return shown(out, "trend", "vol_regime", "regime")


@query()
def wn15_trend_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(features.trend_strength(views.bars_1d(spark, sf_dir)), "trend_strength")


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with all that the daily and swing rules read, but news."""
    b = features.cross_section(features.all_features(views.bars_1d(spark, sf_dir))).withColumns(columns.calendar(86400))
    return rules.prepared(b, rules.DAILY + rules.SWING)


def _catalogue(spark: SparkSession, bars_: DataFrame, chosen: tuple[rules.Rule, ...]) -> DataFrame:
    """Net trades of every variant of the rules whose features are there, one position a symbol and variant."""
    chosen = rules.runnable(chosen, bars_.columns)
    enter, leave = rules.conditions(chosen)
    found = trades.candidates(bars_, rules.variant_table(spark, chosen), enter, leave)
    return trades.net_returns(trades.single_position(found)).withColumn("rule", F.regexp_extract("variant", r"^[^\[]+", 0))


@query()
def pr7_daily_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.metrics(_catalogue(spark, _featured(spark, sf_dir), rules.DAILY), "symbol", "rule", "variant")


@query()
def pr7_swing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.metrics(_catalogue(spark, _featured(spark, sf_dir), rules.applicable(rules.SWING, "daily", "equity")), "symbol", "rule", "variant")


@query()
def pr7_intraday_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.metrics(_catalogue(spark, features.all_features(views.bars_1h(spark, sf_dir)), rules.INTRADAY), "symbol", "rule", "variant")


@query(f"""WITH {SQL_BARS}, h AS (SELECT *, CASE WHEN count(high) OVER w = 20 THEN max(high) OVER w END AS h20, CASE WHEN count(volume) OVER p = 20 THEN volume / nullif(avg(volume) OVER p, 0) END AS vr FROM b
    WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
  x AS (SELECT *, lag(h20) OVER (PARTITION BY symbol ORDER BY ts) AS prev FROM h), g(vol_th, label) AS (VALUES (1.0, '1.0'), (1.2, '1.2'), (1.5, '1.5')), st(stop_atr, slabel) AS (VALUES (1.5, '1.5'), (2.0, '2.0'), (3.0, '3.0'))
  SELECT symbol, 'breakout[vol_th=' || label || ',stop_atr=' || slabel || ']' AS variant, {DAY} FROM x CROSS JOIN g CROSS JOIN st WHERE close > prev AND vr > vol_th""")
def pr6_breakout_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars on which each point of the breakout grid would enter."""
    chosen = tuple(r for r in rules.DAILY if r.name == "breakout")
    b = features.volume_ratio(features.extremes(views.bars_1d(spark, sf_dir)))
    signals = b.crossJoin(F.broadcast(rules.variant_table(spark, chosen))).where(rules.conditions(chosen)[0])
    return signals.select("symbol", "variant", F.to_date("ts").cast("string").alias("day"))


@query()
def ag4_date_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.date_means(_momentum(spark, sf_dir), "variant")


@query()
def ag6_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.cost_analysis(_momentum(spark, sf_dir), "symbol", "variant")


@query()
def ag7_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.stability(trades.metrics(_momentum(spark, sf_dir), "symbol", "variant"), "symbol")


@query()
def rs7_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.monte_carlo(_momentum(spark, sf_dir), "symbol", "variant")


@query(f"""WITH {SQL_QUOTES}, r AS (SELECT symbol, arg_max((bid + ask) / 2, row(ts, seq)) / arg_min((bid + ask) / 2, row(ts, seq)) AS ratio FROM qu GROUP BY 1) SELECT round(avg(ratio) * 10000, 6) AS value, count(*) AS symbols FROM r""")
def ag8_buy_and_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.buy_and_hold(views.quotes(spark, sf_dir), 10000.0).select(F.round("value", 6).alias("value"), "symbols")


@query(f"""WITH {SQL_TRADES}, g AS (SELECT symbol, lag(ts) OVER w AS before, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, epoch_us(before) AS from_us, round(us / 1e6, 6) AS silent_s FROM g WHERE us > 3600000000""")
def ss11_feed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours without a trade (the feed at hand is sparse)."""
    return research.feed_gaps(views.trades(spark, sf_dir), 3600).select("symbol", F.unix_micros("from_ts").alias("from_us"), F.round("silent_s", 6).alias("silent_s"))


@query("""SELECT doc_id AS id, event_type AS symbol FROM documents JOIN events ON doc_id = event_id ORDER BY (event_type = 'purchase') DESC, ts DESC, doc_id LIMIT 50""")
def tk3_latest_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.latest_headlines(views.headlines(spark, sf_dir), ["purchase"], 50).select("id", F.col("symbols")[0].alias("symbol"))


@query(f"""WITH {SQL_TRADES}, b AS (SELECT symbol, date_trunc('hour', ts) AS h, arg_min(price, row(ts, seq)) AS o, arg_max(price, row(ts, seq)) AS c, sum(qty) AS v FROM tr GROUP BY 1, 2)
  SELECT symbol, CAST(h AS VARCHAR) AS bar, round(o, 6) AS open, round(c, 6) AS close, round(v, 6) AS volume FROM b WHERE h + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM tr)""")
def ss1_stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the trade stream; the bar that no later trade has closed yet is not among them."""
    b = drain(stream_bars(views.trade_stream(spark, sf_dir), "1 hour"), "bars")
    return b.select("symbol", F.col("ts").cast("string").alias("bar"), *(F.round(c, 6).alias(c) for c in ("open", "close", "volume")))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the momentum rule for every symbol, also those without trades."""
    symbols = views.bars_1d(spark, sf_dir).select("symbol").distinct()
    return symbols.join(trades.metrics(_momentum(spark, sf_dir).where("variant = 'momentum'"), "symbol"), "symbol", "left")


#: Further modules of registered queries.
MODULES = ("marketlab.queries_books", "marketlab.queries_studies", "marketlab.queries_feeds", "marketlab.queries_streams", "marketlab.queries_rules", "marketlab.queries_landing", "marketlab.queries_desk", "marketlab.queries_sources", "marketlab.queries_cycle")


def _all() -> dict[str, tuple]:
    for module in MODULES:
        import_module(module)
    return _registered


def queries() -> dict:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
