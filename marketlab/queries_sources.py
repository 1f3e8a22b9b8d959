"""Registered queries of payloads and files: the given tables as feeds and vendors would send them, landed in the shared folder and read from there."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.operators.bars import violations
from marketlab.queries import DAY, SQL_BARS, SQL_TRADES, query
from marketlab.sources import bar_files, payloads, views
from marketlab.sources.payloads import OHLCV
from marketlab.sources.store import settled, shared_path

c = F.col


def _utc(*day: int) -> dt.datetime:
    return dt.datetime(*day, tzinfo=dt.timezone.utc)


def _six(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def _text(x: Column) -> Column:
    return x.cast("string")


SQL_OHLCV = ", ".join(f"round({n}, 6) AS {n}" for n in OHLCV)


@query(f"WITH {SQL_BARS} SELECT symbol, {DAY}, {SQL_OHLCV} FROM b WHERE symbol IN ('NO', 'RF') AND ts BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1999-12-31 00:00:00'")
def io1_stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two symbols' daily bars between two days, both included, from a store that holds all and was written twice (IO-1, IO-2)."""
    root = shared_path(spark, "bar-store")
    daily = settled(views.bars_1d(spark, sf_dir).select("symbol", "timeframe", "ts", *OHLCV), "bars")
    bar_files.write_bars(daily.unionByName(views.bars_1h(spark, sf_dir).select("symbol", "timeframe", "ts", *OHLCV)), root)
    bar_files.write_bars(daily.where("symbol = 'RF'"), root)
    got = bar_files.read_bars(spark, root, "1d", ["NO", "RF"], _utc(1996, 1, 1), _utc(1999, 12, 31))
    return got.select("symbol", F.to_date("ts").cast("string").alias("day"), *_six(*OHLCV))


@query(f"WITH {SQL_BARS} SELECT symbol, '1d' AS timeframe, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {', '.join(f'CASE WHEN bad THEN NULL ELSE round({n}, 6) END AS {n}' if n == 'close' else f'round({n}, 6) AS {n}' for n in OHLCV)}, CASE WHEN bad THEN 'no number' END AS problem FROM (SELECT *, CAST(volume AS BIGINT) % 11 = 0 AS bad FROM b)")
def io4_csv_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from CSV by symbol, whose headers differ in names, case and order; some closes are no numbers."""
    b = settled(views.bars_1d(spark, sf_dir), "bars")
    root = shared_path(spark, "csv")
    close = F.when(c("volume").cast("long") % 11 == 0, "n/a").otherwise(_text(c("close")))
    one = [F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), c("open").alias("Open"), c("high").alias("High"), c("low").alias("Low"), close.alias("Close"), c("volume").alias("Volume")]
    two = [c("volume").alias("VOLUME"), F.lit("x").alias("note"), close.alias("CLOSE"), c("low").alias("LOW"), c("high").alias("HIGH"), c("open").alias("OPEN"), F.to_date("ts").alias("DATE")]
    for k, r in enumerate(b.select("symbol").distinct().orderBy("symbol").collect()):
        b.where(c("symbol") == r["symbol"]).select(*(two if k % 2 else one)).write.option("header", True).csv(f"{root}/{r['symbol']}_1d.csv")
    got = bar_files.read_csv(spark, f"{root}/*.csv")
    return got.select("symbol", "timeframe", F.to_date("ts").cast("string").alias("day"), *_six(*OHLCV), "problem")


@query("""WITH v AS (SELECT o_orderstatus AS symbol, CAST(o_orderdate AS DATE) AS day, arg_max(row(o_orderkey, CAST(o_totalprice AS DOUBLE)), o_orderkey) AS r FROM orders GROUP BY 1, 2), p AS (SELECT symbol, day, r[1] AS k, r[2] AS x FROM v),
  q AS (SELECT symbol, day, k, x AS open, CASE WHEN k % 17 <> 0 THEN x * (1 + (k % 3 - 1) / CAST(100 AS DOUBLE)) END AS high, x * 0.98 AS low, CASE WHEN k % 19 = 0 THEN -x ELSE x * 0.99 END AS close, CASE WHEN k % 5 <> 0 THEN k % 5 - 2 END AS volume FROM p)
  SELECT symbol, CAST(day AS VARCHAR) AS day, round(open, 6) AS open, round(greatest(open, high, low, close), 6) AS high, round(least(open, high, low, close), 6) AS low, round(close, 6) AS close, CAST(greatest(coalesce(volume, 0), 0) AS DOUBLE) AS volume, CASE WHEN high IS NULL OR close <= 0 THEN 'no price' END AS problem FROM q""")
def io5_vendor_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a vendor's daily frame in local time: repeated days, missing and negative prices, highs that adjustment has put too low."""
    k, x = c("o_orderkey"), c("o_totalprice").cast("double")
    raw = views.table(spark, sf_dir, "orders").select(c("o_orderstatus").alias("Symbol"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("-05:00")).alias("At"), x.alias("Open"), F.when(k % 17 != 0, x * (1 + (k % 3 - 1) / 100)).alias("High"), (x * 0.98).alias("Low"), F.when(k % 19 == 0, -x).otherwise(x * 0.99).alias("Close"), F.when(k % 5 != 0, k % 5 - 2).cast("double").alias("Volume"), k.alias("Number"))
    got = payloads.daily_vendor(raw, "number")
    return got.select("symbol", F.to_date("ts").cast("string").alias("day"), *_six(*OHLCV), "problem")


#: An exchange's answer holds at most so many rows; a busy day has more pages.
PAGE = 1000


def _by_day(rows: DataFrame, part: Column) -> DataFrame:
    """Payloads of a symbol and day, one for each PAGE numbers: the list of its parts in order of number. Pages count up with the numbers."""
    page = F.floor(F.col("seq") / PAGE)
    return rows.groupBy("symbol", F.to_date("ts").alias("day"), page.alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", part.alias("part")))), lambda s: s["part"]).alias("parts")).select("symbol", F.col("page").alias("seq"), "parts")


SQL_HOURS = SQL_TRADES + ", h AS (SELECT *, date_trunc('hour', ts) AS hour_ts FROM tr)"


@query(f"""WITH {SQL_HOURS}, q AS (SELECT symbol, hour_ts, seq, CASE WHEN seq % 13 <> 0 THEN price END AS open, price * (1 + (seq % 3 - 1) / CAST(100 AS DOUBLE)) AS high, price * 0.98 AS low, CASE WHEN seq % 17 = 0 THEN 0 ELSE price * 0.99 END AS close, CASE WHEN seq % 5 <> 0 THEN qty END AS volume FROM h),
  w AS (SELECT symbol, hour_ts, seq, open, greatest(high, open, close) AS high, least(low, open, close) AS low, close, coalesce(volume, 0) AS volume, CASE WHEN open IS NULL OR close <= 0 THEN 'no price' END AS problem FROM q)
  SELECT symbol, CAST(epoch_us(hour_ts) AS BIGINT) AS at_us, {SQL_OHLCV}, problem FROM (SELECT * FROM w WHERE problem IS NOT NULL UNION ALL SELECT * FROM (SELECT * FROM w WHERE problem IS NULL QUALIFY row_number() OVER (PARTITION BY symbol, hour_ts ORDER BY seq DESC) = 1))""")
def io6_chart_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as charts of parallel arrays, pages of a symbol and day, with repeated hours, nulls and zeros."""
    seq, price = c("seq"), c("price")
    bar = F.struct(F.unix_timestamp(F.date_trunc("hour", "ts")).alias("t"), F.when(seq % 13 != 0, price).alias("open"), (price * (1 + (seq % 3 - 1) / 100)).alias("high"), (price * 0.98).alias("low"), F.when(seq % 17 == 0, 0.0).otherwise(price * 0.99).alias("close"), F.when(seq % 5 != 0, c("qty")).alias("volume"))
    listed = _by_day(views.trades(spark, sf_dir), bar)
    quote = F.struct(*(c("parts")[n].alias(n) for n in OHLCV))
    body = F.struct(F.struct(F.array(F.struct(c("parts")["t"].alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))).alias("result")).alias("chart"))
    got = payloads.chart(settled(listed.select("symbol", "seq", F.to_json(body).alias("payload")), "charts"))
    return got.select("symbol", F.unix_micros("ts").alias("at_us"), *_six(*OHLCV), "problem")


@query(f"""WITH {SQL_HOURS}, q AS (SELECT symbol, epoch_ms(hour_ts) AS open_ms, seq, price AS open, price * 1.01 AS high, price * 0.98 AS low, CASE WHEN seq % 13 <> 0 THEN price * 0.99 END AS close, qty AS volume, qty / 2 AS taker_buy_volume FROM h)
  SELECT symbol, CAST(open_ms AS BIGINT) AS open_ms, {SQL_OHLCV}, round(taker_buy_volume, 6) AS taker_buy_volume, CASE WHEN close IS NULL THEN 'malformed row' END AS problem FROM q QUALIFY close IS NULL OR row_number() OVER (PARTITION BY symbol, open_ms, close IS NULL ORDER BY seq) = 1""")
def io8_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as rows of arrays, pages of a symbol and day; the first of an hour stays, and closes that are no numbers are told."""
    price, text = c("price"), _text
    row = F.array(text(F.unix_millis(F.date_trunc("hour", "ts"))), text(price), text(price * 1.01), text(price * 0.98), F.when(c("seq") % 13 == 0, "?").otherwise(text(price * 0.99)), text(c("qty")), F.lit("0"), F.lit("0"), F.lit("0"), text(c("qty") / 2), F.lit("0"), F.lit("0"))
    got = payloads.klines(settled(_by_day(views.trades(spark, sf_dir), row).select("symbol", "seq", F.to_json("parts").alias("payload")), "klines"))
    return got.select("symbol", "open_ms", *_six(*OHLCV, "taker_buy_volume"), "problem")


@query(r"""WITH d AS (SELECT doc_id, source, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS headline FROM documents)
  SELECT CASE WHEN doc_id % 11 <> 0 THEN CAST(doc_id AS BIGINT) END AS id, CASE WHEN doc_id % 13 <> 0 THEN CAST((doc_id + 1704067200) * 1000000 AS BIGINT) END AS at_us, coalesce(source, '') AS source, length(headline) AS chars, md5(headline) AS headline_md5, upper(coalesce(lang, '') || ',X') AS symbols,
    CASE WHEN doc_id % 11 = 0 THEN 'no id' WHEN doc_id % 13 = 0 THEN 'no time' WHEN coalesce(headline, '') = '' THEN 'no headline' END AS problem FROM d""")
def io9_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of news, a hundred numbers a page; some items have no number or a time that cannot be read."""
    i = c("doc_id")
    at = F.date_format(F.timestamp_seconds(i + 1704067200), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.struct(F.when(i % 11 == 0, "none").otherwise(_text(i)).alias("id"), F.when(i % 13 == 0, "then").otherwise(at).alias("created_at"), c("text").alias("headline"), F.array(F.coalesce("lang", F.lit("")), F.lit("x")).alias("symbols"), "source")
    pages = views.table(spark, sf_dir, "documents").groupBy(F.floor(i / 100).alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("news"))).alias("payload"))
    got = payloads.news(settled(pages, "news"))
    return got.select("id", F.unix_micros("created_at").alias("at_us"), "source", F.length("headline").cast("long").alias("chars"), F.md5("headline").alias("headline_md5"), F.array_join("symbols", ",").alias("symbols"), "problem")


@query(f"""WITH {SQL_TRADES}, k AS (SELECT *, CASE WHEN seq % 23 = 0 THEN 'other' WHEN seq % 29 = 0 THEN 'not an object' WHEN seq % 3 = 0 THEN CASE WHEN seq % 5 = 0 THEN 'malformed quote' ELSE 'quote' END WHEN seq % 7 = 0 THEN 'malformed trade' ELSE 'trade' END AS what FROM tr)
  SELECT seq, CASE WHEN what LIKE '%quote' THEN 'quote' WHEN what LIKE '%trade' THEN 'trade' END AS kind, CASE WHEN what <> 'not an object' THEN upper(symbol) END AS symbol, CASE WHEN what = 'quote' THEN round(price * 0.999, 6) END AS bid, CASE WHEN what LIKE '%quote' THEN 2.0 END AS bid_qty, CASE WHEN what LIKE '%quote' THEN round(price * 1.001, 6) END AS ask,
    CASE WHEN what LIKE '%quote' THEN 3.0 END AS ask_qty, CASE WHEN what LIKE '%trade' THEN round(price, 6) END AS price, CASE WHEN what = 'trade' THEN round(qty, 6) END AS qty, CASE WHEN what LIKE '%trade' THEN buyer_is_maker END AS buyer_is_maker, CASE WHEN what NOT IN ('quote', 'trade') THEN what END AS problem FROM k""")
def io10_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as exchange messages: quotes and trades, wrapped and bare, other kinds, and some that are cut off or lack a field."""
    t, seq, price = views.trades(spark, sf_dir), c("seq"), c("price")
    # Numbers come as texts, and a missing member is left out.
    member = lambda name, x: F.when(x.isNotNull(), F.concat(F.lit(f'"{name}":"'), _text(x), F.lit('"')))
    body = lambda *members: F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    quote = body(member("s", c("symbol")), member("b", F.when(seq % 5 != 0, price * 0.999)), F.lit('"B":2'), member("a", price * 1.001), F.lit('"A":3.0'))
    trade = body(F.lit('"e":"aggTrade"'), member("s", c("symbol")), member("p", price), member("q", F.when(seq % 7 != 0, _text(c("qty"))).otherwise("many")), F.concat(F.lit('"m":'), _text(c("buyer_is_maker"))))
    wrapped = lambda stream, x: F.concat(F.lit(f'{{"stream":"x@{stream}","data":'), x, F.lit("}"))
    payload = F.when(seq % 23 == 0, body(F.lit('"e":"kline"'), member("s", c("symbol")))).when(seq % 29 == 0, F.lit('{"e":"aggTr')).when(seq % 3 == 0, wrapped("bookTicker", quote)).when(seq % 2 == 0, wrapped("aggTrade", trade)).otherwise(trade)
    got = payloads.messages(settled(t.select("seq", payload.alias("payload")), "messages"))
    return got.select("seq", "kind", "symbol", *_six("bid", "bid_qty", "ask", "ask_qty", "price", "qty"), "buyer_is_maker", "problem")


@query("""SELECT 'P' || p_partkey AS symbol, p_brand AS base_asset, CASE WHEN p_partkey % 7 <> 0 THEN p_type ELSE '' END AS quote_asset, CASE WHEN p_partkey % 5 = 0 THEN 1e-8 ELSE p_size / CAST(100 AS DOUBLE) END AS step_size, CAST(CASE p_partkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 0 END AS DOUBLE) AS min_notional,
  CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE round(CAST(p_retailprice AS DOUBLE), 6) END AS volume_24h FROM part""")
def io15_symbol_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an exchange's metadata in pages of fifty: nested filters, some missing, and volumes from another payload."""
    p, k = views.table(spark, sf_dir, "part"), c("p_partkey")
    kind = lambda name, field, x: F.create_map(F.lit("filterType"), F.lit(name), F.lit(field), x)
    filters = F.array_compact(F.array(F.when(k % 3 == 0, kind("NOTIONAL", "minNotional", F.lit("10"))), F.when(k % 3 < 2, kind("MIN_NOTIONAL", "minNotional", F.lit("5"))), F.when(k % 5 != 0, kind("LOT_SIZE", "stepSize", _text(c("p_size") / 100)))))
    item = F.struct(F.concat(F.lit("P"), k).alias("symbol"), c("p_brand").alias("baseAsset"), F.when(k % 7 != 0, c("p_type")).alias("quoteAsset"), filters.alias("filters"))
    pages = p.groupBy(F.floor(k / 50)).agg(F.to_json(F.struct(F.collect_list(item).alias("symbols"))).alias("payload"))
    tickers = p.where(k % 4 != 0).select(F.concat(F.lit("P"), k).alias("symbol"), _text(c("p_retailprice")).alias("volume"))
    return payloads.symbol_info(settled(pages.select("payload"), "info"), tickers).withColumn("volume_24h", F.round("volume_24h", 6))


@query("SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(NULL AS VARCHAR) AS problem FROM orders UNION ALL SELECT NULL, 'no date'")
def io19_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which orders came, from calendars by customer nation's remainder that overlap and end with a broken row."""
    o = views.table(spark, sf_dir, "orders").select((c("o_custkey") % 25).alias("page"), F.to_date("o_orderdate").cast("string").alias("date")).distinct()
    pages = o.groupBy("page").agg(F.to_json(F.concat(F.collect_list(F.struct("date")), F.array(F.struct(F.lit("never").alias("date"))))).alias("payload"))
    return payloads.trading_days(settled(pages.select("payload"), "calendar")).select(_text(c("day")).alias("day"), "problem")


@query("""WITH k AS (SELECT o_orderkey AS k, o_orderstatus AS symbol, CAST(o_orderdate AS DATE) AS ts, CAST(o_totalprice AS DOUBLE) AS x FROM orders), v AS (SELECT symbol, ts, x AS open, CASE WHEN k % 17 <> 0 THEN x * (1 + (k % 3 - 1) / CAST(100 AS DOUBLE)) END AS high, x * CASE WHEN k % 7 = 0 THEN 1.005 ELSE 0.98 END AS low, CASE WHEN k % 19 = 0 THEN -x ELSE x * 0.99 END AS close, CAST(k % 5 - 1 AS DOUBLE) AS volume FROM k),
  f AS (SELECT 'missing' AS rule, symbol, ts FROM v WHERE high IS NULL UNION ALL SELECT 'not_positive', symbol, ts FROM v WHERE least(open, high, low, close) <= 0 UNION ALL SELECT 'high_too_low', symbol, ts FROM v WHERE high < greatest(open, close, low) - 1e-9 UNION ALL SELECT 'low_too_high', symbol, ts FROM v WHERE low > least(open, close) + 1e-9
    UNION ALL SELECT 'negative_volume', symbol, ts FROM v WHERE volume < 0 UNION ALL SELECT 'repeated_time', symbol, ts FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol, ts) AS i FROM v) WHERE i > 1) SELECT rule, symbol, CAST(ts AS VARCHAR) AS day, count(*) AS n FROM f GROUP BY 1, 2, 3""")
def io11_broken_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders taken for bars without any repair: each rule is broken by many of them."""
    k, x = c("o_orderkey"), c("o_totalprice").cast("double")
    rows = views.table(spark, sf_dir, "orders").select(c("o_orderstatus").alias("symbol"), c("o_orderdate").cast("timestamp").alias("ts"), x.alias("open"), F.when(k % 17 != 0, x * (1 + (k % 3 - 1) / 100)).alias("high"), (x * F.when(k % 7 == 0, 1.005).otherwise(0.98)).alias("low"), F.when(k % 19 == 0, -x).otherwise(x * 0.99).alias("close"), (k % 5 - 1).cast("double").alias("volume"))
    return violations(rows).groupBy("rule", "symbol", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
