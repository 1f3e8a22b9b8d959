"""Registered queries of feeds: quotes, signs, paths, news, landed payloads, identities, funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.functions import columns
from marketlab.operators import bars, feeds, ticks
from marketlab.queries import DAY, SQL_BARS, SQL_QUOTES, SQL_TRADES, query, shown
from marketlab.queries_studies import rounded
from marketlab.sources import books, views
from marketlab.sources.books import SQL_RULES, SQL_TRIPS


@query("""WITH q AS (SELECT o_orderkey AS seq, CAST(o_totalprice AS DOUBLE) * (o_custkey % 7 - 1) AS bid, CAST(o_totalprice AS DOUBLE) * (o_custkey % 7 - 1) * (1 + (o_orderkey % 4 - 1) * CAST(0.001 AS DOUBLE)) AS ask FROM orders), m AS (SELECT *, (bid + ask) / 2 AS mid FROM q)
  SELECT seq, round(mid, 7) AS mid, CASE WHEN mid > 0 THEN round((ask - bid) / mid, 8) END AS spread_pct, mid <= 0 AS endless, bid > 0 AND ask >= bid AS valid FROM m""")
def sc3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of which some are crossed, locked, or not positive; ``endless``: the spread is infinite."""
    k = F.col("o_orderkey")
    q = views.table(spark, sf_dir, "orders").select(k.alias("seq"), (F.col("o_totalprice").cast("double") * (F.col("o_custkey") % 7 - 1)).alias("bid"))
    q = q.withColumn("ask", F.col("bid") * (1 + (F.col("seq") % 4 - 1) * 0.001)).withColumns(columns.quote_values())
    endless = F.col("spread_pct") == float("inf")
    return q.select("seq", F.round("mid", 7).alias("mid"), F.when(~endless, F.round("spread_pct", 8)).alias("spread_pct"), endless.alias("endless"), "valid")


def _kind_sql(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?i){p}') THEN '{kind}'" for kind, p in columns.HEADLINE_KINDS) + " ELSE 'other' END"


LEAD = "CASE doc_id % 5 WHEN 0 THEN 'Q2 results beat: ' WHEN 1 THEN 'Merger talks: ' WHEN 2 THEN 'FDA probe: ' WHEN 3 THEN 'Fed holds interest rates: ' ELSE '' END || text"


@query(f"SELECT kind, count(*) AS n FROM (SELECT {_kind_sql(LEAD)} AS kind FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def sc4_headline_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of documents behind made-up leads."""
    d = views.table(spark, sf_dir, "documents").where("text is not null")
    return d.select(columns.headline_kind(F.expr(LEAD)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


SQL_PHI = "CASE WHEN z >= 0 THEN 1 - u ELSE u END"


@query(f"""WITH {SQL_BARS}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM b), s AS (SELECT *, CASE WHEN count(r) OVER w >= 10 THEN stddev_samp(r) OVER w END AS sd FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING)),
  z AS (SELECT *, CASE WHEN r / nullif(sd, 0) IS NOT NULL THEN least(greatest(r / nullif(sd, 0), -10), 10) END AS z FROM s), t AS (SELECT *, 1 / (1 + CAST(0.2316419 AS DOUBLE) * abs(z)) AS t FROM z),
  u AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) AS u FROM t)
  SELECT symbol, {DAY}, round(volume * coalesce({SQL_PHI}, 0.5), 5) AS taker_buy_volume FROM u""")
def wn24_bulk_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ticks.bulk_volume(views.bars_1d(spark, sf_dir).drop("taker_buy_volume")), "taker_buy_volume", digits=5)


@query(f"WITH {SQL_BARS} SELECT symbol, {DAY}, CAST(step AS INTEGER) AS step, round(price, 8) AS price FROM (SELECT symbol, ts, unnest(range(0, 4)) AS step, unnest(CASE WHEN close >= open THEN [open, low, high, close] ELSE [open, high, low, close] END) AS price FROM b)")
def sc20_bar_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ticks.bar_path(views.bars_1d(spark, sf_dir), 86_400), "step", "price", digits=8)


@query(f"""WITH {SQL_QUOTES}, k AS (SELECT t.symbol, t.ts, t.seq, t.price, q.bid, q.ask FROM tr AS t ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 1 SECOND AS ts, bid, ask FROM qu) AS q ON t.symbol = q.symbol AND t.ts >= q.ts),
  s AS (SELECT *, CASE WHEN price >= ask THEN 1 WHEN price <= bid THEN -1 WHEN price > lag(price) OVER w THEN 1 WHEN price < lag(price) OVER w THEN -1 END AS sure FROM k WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq))
  SELECT symbol, seq, CAST(coalesce(last_value(sure IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq), CASE WHEN price >= (bid + ask) / 2 THEN 1 ELSE -1 END) AS INTEGER) AS side FROM s""")
def ss12_aggressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side of every trade against the quote known for a second."""
    late = views.quotes(spark, sf_dir).withColumn("ts", F.expr("ts + interval 1 second"))
    return ticks.signed_trades(views.trades(spark, sf_dir).select("symbol", "ts", "seq", "price"), late).select("symbol", "seq", "side")


#: Counts of headlines before each hourly bar ends, and what is covered.
SQL_NEWS = f"""{SQL_TRADES}, h AS (SELECT symbol, date_trunc('hour', ts) AS ts, date_trunc('hour', ts) + INTERVAL 55 MINUTE AS cut FROM tr GROUP BY 1, 2, 3), n AS (SELECT event_type AS symbol, CAST(e.ts AS TIMESTAMP) AS made, {_kind_sql('text')} = 'earnings' AS e FROM documents JOIN events e ON doc_id = event_id),
  k AS (SELECT min(ts) AS lo, max(ts) AS hi FROM tr), c AS (SELECT h.symbol, h.ts, cut, count(*) FILTER (made > cut - INTERVAL 1 DAY) AS d, count(made) - count(*) FILTER (made > cut - INTERVAL 1 DAY) AS base, count(*) FILTER (made > cut - INTERVAL 1 DAY AND e) AS ed FROM h LEFT JOIN n ON n.symbol = h.symbol AND made <= cut AND made > cut - INTERVAL 21 DAY GROUP BY 1, 2, 3)"""


@query(f"""WITH {SQL_NEWS}
  SELECT symbol, CAST(ts AS VARCHAR) AS bar, CASE WHEN known THEN CAST(d AS DOUBLE) END AS news_1d, CASE WHEN known THEN round(d / (base / CAST(20 AS DOUBLE) + 1), 6) END AS news_ratio, CASE WHEN known THEN CAST(ed AS DOUBLE) END AS news_earnings_1d FROM (SELECT *, cut - INTERVAL 21 DAY >= lo AND cut <= hi AS known FROM c, k)""")
def rs15_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News features of hourly bars, null where headlines are not covered (RS-14's join, RS-15, JN-3)."""
    covered = views.trades(spark, sf_dir).agg(F.min("ts").alias("covered_from"), F.max("ts").alias("covered_until"))
    out = feeds.news_features(views.bars_1h(spark, sf_dir).select("symbol", "ts"), views.headlines(spark, sf_dir), covered, 3600)
    return out.select("symbol", F.col("ts").cast("string").alias("bar"), "news_1d", F.round("news_ratio", 6).alias("news_ratio"), "news_earnings_1d")


@query(f"WITH {SQL_TRADES}, b AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, row(ts, seq)) AS o, max(price) AS h, min(price) AS l, arg_max(price, row(ts, seq)) AS c, sum(qty) AS v FROM tr GROUP BY 1, 2) SELECT symbol, CAST(ts AS VARCHAR) AS bar, round(o, 6) AS open, round(h, 6) AS high, round(l, 6) AS low, round(c, 6) AS close, round(v, 6) AS volume FROM b WHERE CAST(ts AS TIME) < TIME '20:00:00'")
def io7_bars_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, landed as one JSON payload a day and read back: symbol to a list of bars, those before 20:00."""
    b = views.bars_1h(spark, sf_dir)
    own = b.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))).alias("rows"))
    payloads = own.groupBy("day").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("symbol", "rows"))).alias("bars"))).alias("payload"))
    rows = feeds.bars_from_json(payloads).where(F.hour("ts") < 20)
    return rounded(rows.withColumn("bar", F.col("ts").cast("string")), "symbol", "bar", "open", "high", "low", "close", "volume")


@query("SELECT o_orderkey AS seq, CASE WHEN o_orderpriority LIKE '%URGENT' THEN 'URGENT' WHEN o_orderpriority LIKE '%HIGH' THEN 'HIGH' WHEN o_orderpriority LIKE '%LOW' THEN 'LOW' END AS currency FROM orders")
def sc19_quote_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known suffix of each name; the first that fits counts, null if none does."""
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), feeds.known_suffix(F.col("o_orderpriority"), ("URGENT", "HIGH", "LOW")).alias("currency"))


@query(f"WITH {SQL_RULES} SELECT status, count(DISTINCT rule) AS rules, count(*) AS changes FROM re GROUP BY 1")
def ag10_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that ever reached each status (AG-10, EV-4)."""
    return books.rule_events(spark, sf_dir).groupBy("status").agg(F.count_distinct("rule").alias("rules"), F.count("*").alias("changes"))


@query(f"WITH {SQL_TRIPS}, c AS (SELECT strategy, count(*) FILTER (book = 'shadow') AS n, count(*) FILTER (book = 'paper' AND symbol = 'F') AS last_n FROM rt GROUP BY 1) SELECT strategy, n AS examples, CAST(CASE WHEN last_n > 0 THEN greatest(60, ceil(last_n * CAST(1.5 AS DOUBLE))) ELSE 60 END AS BIGINT) AS needed FROM c")
def ev4_learning_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples each strategy has and needs before it is learned from again (AG-11, EV-4, ML-6)."""
    t = books.round_trips(spark, sf_dir)
    c = t.groupBy("strategy").agg(F.count(F.when(F.col("book") == "shadow", 1)).alias("examples"), F.count(F.when((F.col("book") == "paper") & (F.col("symbol") == "F"), 1)).alias("last_n"))
    return c.select("strategy", "examples", feeds.needed_examples(F.col("last_n")).alias("needed"))


@query(f"WITH {SQL_TRADES}, b AS (SELECT symbol, epoch(date_trunc('hour', ts))::BIGINT AS s, arg_max(price, row(ts, seq)) AS close FROM tr GROUP BY 1, date_trunc('hour', ts)), g AS (SELECT *, (lead(s) OVER (PARTITION BY symbol ORDER BY s) - s) // 3600 - 1 AS m FROM b) SELECT symbol, s, round(close, 6) AS close, false AS quiet FROM b UNION ALL SELECT symbol, s + k * 3600, round(close, 6), true FROM (SELECT *, unnest(range(1, m + 1)) AS k FROM g WHERE m BETWEEN 1 AND 120)")
def ss2_quiet_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with flat ones for quiet hours; longer outages stay open."""
    b = views.bars_1h(spark, sf_dir)
    return bars.fill_quiet(b, 3600).select("symbol", F.unix_timestamp("ts").alias("s"), F.round("close", 6).alias("close"), (F.col("volume") == 0).alias("quiet"))
