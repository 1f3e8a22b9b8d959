"""Registered queries of landed tables: the tick log, days, headlines, audit rows, versions, fingerprints. Each lands the given tables in the shared folder and reads what is there then."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.queries import SQL_BARS, SQL_TRADES, query
from marketlab.sources import landing, views
from marketlab.sources.store import shared_path
from marketlab.streaming.bars import drain

START, END = dt.datetime(2024, 1, 3, 6, 30), dt.datetime(2024, 1, 9)


def _utc(t: dt.datetime):
    """UTC, wherever the driver runs."""
    return t.replace(tzinfo=dt.timezone.utc)


@query(f"""WITH {SQL_TRADES}, l AS (SELECT symbol, ts, seq, 'T' AS kind FROM tr UNION ALL SELECT symbol, ts, seq, 'Q' FROM tr WHERE seq % 7 <> 3) SELECT symbol, kind, count(*) AS n, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us
  FROM l WHERE symbol IN ('click', 'error') AND ts >= TIMESTAMP '2024-01-03 06:30:00' AND ts < TIMESTAMP '2024-01-09 00:00:00' GROUP BY 1, 2""")
def io12_tick_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of two symbols between two times, from a log by day and symbol."""
    t = views.trades(spark, sf_dir).select("symbol", "ts", "seq")
    path = shared_path(spark, "ticks")
    landing.write_ticks(t.withColumn("kind", F.lit("T")).unionByName(t.where("seq % 7 <> 3").withColumn("kind", F.lit("Q"))), path)
    s = landing.tick_summary(landing.read_ticks(spark, path, _utc(START), _utc(END), ["click", "error"]))
    return s.select("symbol", "kind", "n", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query("""WITH o AS (SELECT 'r' || (o_custkey % 2) AS run_id, o_orderkey AS order_id, o_orderstatus AS symbol, CASE WHEN o_orderkey % 3 = 0 THEN 'sell' ELSE 'buy' END AS side, CAST(o_totalprice AS DOUBLE) AS quantity FROM orders),
  f AS (SELECT l_orderkey AS order_id, arg_max(CAST(l_extendedprice AS DOUBLE), row(l_shipdate, l_linenumber, l_extendedprice, l_tax)) AS price, arg_max(CAST(l_tax AS DOUBLE), row(l_shipdate, l_linenumber, l_extendedprice, l_tax)) AS fee FROM lineitem GROUP BY 1)
  SELECT run_id, o.order_id, symbol, side, round(quantity, 2) AS quantity, CASE WHEN f.order_id IS NULL THEN 'NEW' ELSE 'FILLED' END AS status, round(price, 2) AS fill_price, round(fee, 4) AS fee FROM o LEFT JOIN f ON f.order_id = o.order_id""")
def io13_order_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after their log: accepted twice (the second entry counts), then filled by their line items; a repeated batch changes nothing."""
    o, li, c = views.table(spark, sf_dir, "orders"), views.table(spark, sf_dir, "lineitem"), F.col
    run, at = F.concat(F.lit("r"), c("o_custkey") % 2), c("o_orderdate").cast("timestamp")
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    accepted = lambda seq, quantity, status: o.select(run.alias("run_id"), c("o_orderkey").alias("order_id"), at.alias("ts"), F.lit(seq).cast("long").alias("seq"), F.lit("order").alias("kind"), c("o_orderstatus").alias("symbol"), F.when(c("o_orderkey") % 3 == 0, "sell").otherwise("buy").alias("side"), quantity.cast("double").alias("quantity"), F.lit(status).alias("status"), none.alias("price"), none.alias("fee"))
    owner = o.select(run.alias("run_id"), c("o_orderkey").alias("order_id"))
    fills = li.select(c("l_orderkey").alias("order_id"), c("l_shipdate").cast("timestamp").alias("ts"), (c("l_linenumber") * F.lit(10**12) + F.round(c("l_extendedprice") * 100).cast("long") * 100 + F.round(c("l_tax") * 100).cast("long")).alias("seq"), F.lit("fill").alias("kind"), text.alias("symbol"), text.alias("side"), none.alias("quantity"), text.alias("status"), c("l_extendedprice").cast("double").alias("price"), c("l_tax").cast("double").alias("fee")).join(owner, "order_id")
    path = shared_path(spark, "audit")
    for number, batch in enumerate((accepted(0, F.lit(1.0), "SENT"), accepted(1, c("o_totalprice"), "NEW"), fills, fills)):
        landing.land_batch(batch, path, min(number, 2))
    s = landing.order_state(spark.read.parquet(path))
    return s.select("run_id", "order_id", "symbol", "side", F.round("quantity", 2).alias("quantity"), "status", F.round("fill_price", 2).alias("fill_price"), F.round("fee", 4).alias("fee"))


@query("""WITH a AS (SELECT DISTINCT p_brand AS strategy, p_type AS spec FROM part WHERE p_partkey % 3 = 0), b AS (SELECT DISTINCT p_brand AS strategy, p_type AS spec FROM part),
  va AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY sha256(spec)) AS version FROM a), n AS (SELECT * FROM b ANTI JOIN a USING (strategy, spec)), m AS (SELECT strategy, max(version) AS most FROM va GROUP BY 1)
  SELECT strategy, CAST(version AS INTEGER) AS version, sha256(spec) AS hash FROM va UNION ALL SELECT n.strategy, CAST(coalesce(most, 0) + row_number() OVER (PARTITION BY n.strategy ORDER BY sha256(spec)) AS INTEGER), sha256(spec) FROM n LEFT JOIN m ON m.strategy = n.strategy""")
def io14_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of strategies after two studies, the second of which has all of the first's specs and more."""
    specs = views.table(spark, sf_dir, "part").select(F.col("p_brand").alias("strategy"), F.col("p_type").alias("spec"), "p_partkey")
    path = shared_path(spark, "versions")
    landing.new_versions(specs.where("p_partkey % 3 = 0"), spark.createDataFrame([], "strategy string, version int, hash string")).write.parquet(path)
    known = spark.read.parquet(path)
    return known.unionByName(landing.new_versions(specs, known)).select("strategy", "version", "hash")


@query("""WITH h AS (SELECT doc_id AS id, CAST(e.ts AS TIMESTAMP) AS made FROM documents JOIN events AS e ON doc_id = event_id)
  SELECT id, CAST(epoch_us(made) AS BIGINT) AS at_us FROM h WHERE made >= TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 22 DAY AND made < TIMESTAMP '2024-01-12 00:00:00'""")
def io16_headline_pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pulls, each from a little before the end of the one before: every headline once."""
    h = views.headlines(spark, sf_dir).select("id", "created_at")
    root = shared_path(spark, "news")
    for now in (dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 9, 12), dt.datetime(2024, 1, 12)):
        since = landing.pull_from(spark, root, now)
        landing.land_headlines(h.where((F.col("created_at") >= F.lit(since)) & (F.col("created_at") < F.lit(now))), root, since, now)
    return spark.read.parquet(f"{root}/headlines").select("id", F.unix_micros("created_at").alias("at_us"))


@query("SELECT event_id AS id, CAST(epoch_us(CAST(ts AS TIMESTAMP)) AS BIGINT) AS at_us FROM events")
def ss13_headline_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in which every third event comes twice, with each once."""
    t = views.trade_stream(spark, sf_dir).select(F.col("seq").alias("id"), F.col("ts").alias("created_at"))
    return drain(landing.once_on_stream(t.unionByName(t.where("id % 3 = 0"))), "news").select("id", F.unix_micros("created_at").alias("at_us"))


@query(f"""WITH {SQL_TRADES}, d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM tr WHERE symbol = 'error' GROUP BY 1), w AS (SELECT CAST(unnest(generate_series(DATE '2023-12-28', DATE '2024-01-12', INTERVAL 1 DAY)) AS DATE) AS day)
  SELECT CAST(w.day AS VARCHAR) AS day, coalesce(n, 0) AS n, w.day < DATE '2024-01-12' AS complete FROM w LEFT JOIN d ON d.day = w.day WHERE isodow(w.day) < 6""")
def io17_landed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays landed in two runs, the second of which asks again only for what was not over; days before the data are empty ones."""
    b = views.trades(spark, sf_dir).where("symbol = 'error'")
    root = shared_path(spark, "days")
    for now in (dt.datetime(2024, 1, 5, 12), dt.datetime(2024, 1, 12, 12)):
        landing.land_days(b.where(F.col("ts") < F.lit(now)) if now.day == 5 else b, root, landing.wanted_days(spark, root, dt.date(2023, 12, 28), now.date()), now)
    stored = spark.read.parquet(f"{root}/bars").groupBy("day").agg(F.count("*").alias("stored"))
    days = landing.known_days(spark, root).join(stored, "day", "left").where(F.coalesce("stored", F.lit(0)) == F.col("n"))
    return days.select(F.col("day").cast("string").alias("day"), "n", "complete")


SQL_PRINT = """fp AS (SELECT symbol, md5('=' || epoch(ts)::BIGINT || '|=' || CAST(volume AS BIGINT) || '|=' || CAST(round(close * 100) AS BIGINT)) AS h FROM b), fs AS (SELECT symbol, count(*) AS n, sum(CAST('0x' || h[1:15] AS BIGINT)::HUGEINT) AS a, sum(CAST('0x' || h[17:31] AS BIGINT)::HUGEINT) AS c FROM fp GROUP BY 1), fk AS (SELECT symbol, n, sha256(n || ':' || a || ':' || c) AS fingerprint FROM fs)"""


@query(f"WITH {SQL_BARS}, {SQL_PRINT} SELECT symbol, n, fingerprint FROM fk UNION ALL SELECT '*', count(*), sha256(string_agg(symbol || ':' || fingerprint, '|' ORDER BY symbol)) FROM fk")
def ag16_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each symbol's daily bars, and of all together."""
    b = views.bars_1d(spark, sf_dir).select("symbol", F.unix_timestamp("ts").alias("s"), F.col("volume").cast("long").alias("v"), F.round(F.col("close") * 100).cast("long").alias("c"))
    by = landing.fingerprint(b, ["s", "v", "c"])
    return by.unionByName(landing.study_fingerprint(by).select(F.lit("*").alias("symbol"), F.col("keys").alias("n"), "fingerprint"))
