"""Payloads as feeds and vendors send them, landed as rows of text, to typed rows.

Nothing is dropped silently: a part of a payload that cannot be read comes out as a row with ``problem``, and problems() counts them. A payload is parsed where it lies:
no shuffle but for removing repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OHLCV = ("open", "high", "low", "close", "volume")
STRINGS = "map<string,string>"


def _number(text: Column) -> Column:
    """A finite number, else null."""
    x = F.trim(text).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _object(text: Column) -> Column:
    """The members of a JSON object as texts (names keep their case); null for anything else."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, STRINGS))


def _strip(text: Column) -> Column:
    """Without white space at both ends, of whatever kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def fine(rows: DataFrame) -> DataFrame:
    return rows.where("problem is null").drop("problem")


def problems(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by problem; those without are ``ok``."""
    return rows.groupBy(*keys, F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


def messages(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Exchange messages, bare or wrapped as {stream, data}: other columns, kind (quote, trade), symbol, bid, bid_qty, ask, ask_qty, price, qty, buyer_is_maker, problem.

    A quote is known by its stream or by its four fields, a trade by its stream or event name. Messages of other kinds have the problem ``other``.
    """
    rows = payloads.withColumn("_m", _object(F.col(column)))
    wrapped = F.map_contains_key("_m", "data")
    rows = rows.withColumns({"_stream": F.coalesce(F.col("_m")["stream"], F.lit("")), "_d": F.when(wrapped, _object(F.col("_m")["data"])).otherwise(F.col("_m"))})
    d, has = (lambda k: F.col("_d")[k]), lambda k: F.map_contains_key("_d", k)
    quote = F.endswith("_stream", F.lit("@bookTicker")) | (has("b") & has("a") & has("B") & has("A"))
    trade = F.coalesce(d("e") == "aggTrade", F.lit(False)) | F.endswith("_stream", F.lit("@aggTrade"))
    kind = F.when(quote, "quote").when(trade, "trade")
    out = {"symbol": F.upper(d("s")), "bid": _number(d("b")), "bid_qty": _number(d("B")), "ask": _number(d("a")), "ask_qty": _number(d("A")), "price": _number(d("p")), "qty": _number(d("q")), "buyer_is_maker": F.lower(d("m")).try_cast("boolean")}
    quoted, traded = ("bid", "bid_qty", "ask", "ask_qty"), ("price", "qty", "buyer_is_maker")
    values = rows.withColumns({"kind": kind, **{n: F.when(kind == "quote", out[n]) for n in quoted}, **{n: F.when(kind == "trade", out[n]) for n in traded}, "symbol": out["symbol"]})
    whole = lambda names: F.forall(F.array(*(F.col(n).isNotNull() for n in ("symbol", *names))), lambda x: x)
    bad = F.when(F.col("_d").isNull(), "not an object").when(F.col("kind").isNull(), "other").when((F.col("kind") == "quote") & ~whole(quoted), "malformed quote").when((F.col("kind") == "trade") & ~whole(traded), "malformed trade")
    return values.withColumn("problem", bad).drop("_m", "_d", "_stream", column)


def klines(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Rows of arrays (open time in ms, prices and volume, then at place 9 what buyers took): symbol, open_ms, open .. volume, taker_buy_volume, problem.

    payloads: symbol, seq and the payload. Of rows of one time, the first by seq and place stays; rows that cannot be read all stay.
    """
    lists = F.from_json(column, "array<string>")
    rows = payloads.select("symbol", "seq", F.posexplode_outer(lists).alias("place", "_row"))
    cells = rows.withColumn("_c", F.from_json("_row", "array<string>"))
    at = lambda k: F.get("_c", F.lit(k))
    values = cells.select("symbol", "seq", "place", F.trim(at(0)).try_cast("long").alias("open_ms"), *(_number(at(k)).alias(n) for k, n in zip((1, 2, 3, 4, 5, 9), (*OHLCV, "taker_buy_volume"))), "_row")
    missing = F.exists(F.array(*(F.col(n).isNull() for n in ("open_ms", *OHLCV, "taker_buy_volume"))), lambda x: x)
    told = values.withColumn("problem", F.when(F.col("_row").isNull(), "no rows").when(missing, "malformed row"))
    first = F.struct("seq", "place")
    good = told.where("problem is null").groupBy("symbol", "open_ms").agg(*(F.min_by(n, first).alias(n) for n in (*OHLCV, "taker_buy_volume"))).withColumn("problem", F.lit(None).cast("string"))
    return good.unionByName(told.where("problem is not null").select(*good.columns))


def news(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """{news: [..]}: id, created_at, headline, symbols (upper case), source, url, summary, problem. A headline that is null counts as missing."""
    rows = payloads.select(F.explode_outer(F.from_json(_object(F.col(column))["news"], "array<string>")).alias("_row")).withColumn("_d", _object(F.col("_row")))
    d = lambda k: F.col("_d")[k]
    symbols = F.transform(F.coalesce(F.from_json(d("symbols"), "array<string>"), F.array().cast("array<string>")), F.upper)
    out = rows.select(
        F.trim(d("id")).try_cast("long").alias("id"), F.try_to_timestamp(d("created_at")).alias("created_at"), _strip(d("headline")).alias("headline"), symbols.alias("symbols"), F.coalesce(d("source"), F.lit("")).alias("source"),
        F.coalesce(d("url"), F.lit("")).alias("url"), _strip(F.coalesce(d("summary"), F.lit(""))).alias("summary"), F.col("_row").isNull().alias("_none"),
    )
    bad = F.when(F.col("_none"), "no news").when(F.col("id").isNull(), "no id").when(F.col("created_at").isNull(), "no time").when(F.coalesce("headline", F.lit("")) == "", "no headline")
    return out.withColumn("problem", bad).drop("_none")


CHART = "chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>>>>>"


def chart(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Parallel arrays of a chart: symbol, ts, open .. volume, problem. high and low are widened to open and close; no volume is zero; of bars of one time the last stays.

    payloads: symbol, seq and the payload.
    """
    result = F.get(F.from_json(column, CHART)["chart"]["result"], F.lit(0))
    rows = payloads.select("symbol", "seq", result["timestamp"].alias("_t"), F.get(result["indicators"]["quote"], F.lit(0)).alias("_q"))
    bars = rows.select("symbol", "seq", F.posexplode_outer(F.arrays_zip("_t", *(F.coalesce(F.col("_q")[n], F.array().cast("array<double>")).alias(n) for n in OHLCV))).alias("place", "_b"))
    flat = bars.select("symbol", "seq", "place", F.timestamp_seconds(F.col("_b")["_t"]).alias("ts"), *(F.col("_b")[n].alias(n) for n in OHLCV))
    return _repaired(flat, F.struct("seq", "place"), F.when(F.col("place").isNull(), "no bars"), ("open", "close"))


def daily_vendor(rows: DataFrame, order: str) -> DataFrame:
    """Daily bars whose ``at`` is local time with its offset (text) and whose columns are named in any case: symbol, ts (the local date, at midnight UTC), open .. volume, problem.

    Of bars of one day the last by ``order`` stays, before prices are looked at; volume is at least zero; high and low are widened to all four prices.
    """
    named = rows.toDF(*(c.lower() for c in rows.columns))
    dated = named.select("symbol", F.try_to_timestamp(F.substring("at", 1, 10)).alias("ts"), *(F.col(n).cast("double").alias(n) for n in OHLCV), F.col(order.lower()).alias("_order"))
    last = dated.groupBy("symbol", "ts").agg(*(F.max_by(n, F.struct("_order")).alias(n) for n in OHLCV))
    return _repaired(last.withColumn("volume", F.greatest("volume", F.lit(0.0))), None, F.lit(None).cast("string"), OHLCV[:4])


def _repaired(bars: DataFrame, order: Column | None, bad: Column, within: tuple[str, ...]) -> DataFrame:
    """Bars with positive prices, high and low widened; with order, the last of each time."""
    known = F.forall(F.array(*(F.coalesce(F.col(n) > 0, F.lit(False)) & ~F.isnan(n) for n in OHLCV[:4])), lambda x: x)
    told = bars.withColumn("problem", bad).withColumn("problem", F.coalesce("problem", F.when(F.col("ts").isNull(), "no time").when(~known, "no price")))
    told = told.withColumns({"high": F.greatest("high", *within), "low": F.least("low", *within), "volume": F.coalesce(F.nanvl("volume", F.lit(0.0)), F.lit(0.0))})
    columns = ("symbol", "ts", *OHLCV, "problem")
    if order is None:
        return told.select(*columns)
    good = told.where("problem is null").groupBy("symbol", "ts").agg(*(F.max_by(n, order).alias(n) for n in (*OHLCV, "problem")))
    return good.select(*columns).unionByName(told.where("problem is not null").select(*columns))


SYMBOLS = "symbols array<struct<symbol:string,baseAsset:string,quoteAsset:string,filters:array<map<string,string>>>>"


def symbol_info(payloads: DataFrame, tickers: DataFrame, column: str = "payload") -> DataFrame:
    """Exchange metadata: symbol, base_asset, quote_asset, step_size, min_notional, volume_24h (0 where tickers (symbol, volume) do not know it).

    A later filter of a type counts for an earlier one; NOTIONAL goes before MIN_NOTIONAL.
    """
    rows = payloads.select(F.inline(F.from_json(column, SYMBOLS)["symbols"]))
    last = lambda kind: F.element_at(F.filter(F.coalesce("filters", F.array().cast(f"array<{STRINGS}>")), lambda f: f["filterType"] == kind), -1)
    own = lambda kind: F.when(F.exists(F.coalesce("filters", F.array().cast(f"array<{STRINGS}>")), lambda f: f["filterType"] == kind), last(kind))
    notional = F.coalesce(own("NOTIONAL"), own("MIN_NOTIONAL"))
    out = rows.where("symbol is not null").select("symbol", F.coalesce("baseAsset", F.lit("")).alias("base_asset"), F.coalesce("quoteAsset", F.lit("")).alias("quote_asset"), F.coalesce(_number(own("LOT_SIZE")["stepSize"]), F.lit(1e-8)).alias("step_size"), F.coalesce(_number(notional["minNotional"]), F.lit(0.0)).alias("min_notional"))
    volumes = tickers.groupBy(F.col("symbol")).agg(F.max(F.col("volume").cast("double")).alias("volume_24h"))
    return out.join(volumes, "symbol", "left").withColumn("volume_24h", F.coalesce("volume_24h", F.lit(0.0)))


def trading_days(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Rows of a calendar ([{date: ..}, ..]): day, problem; each day once."""
    rows = payloads.select(F.explode_outer(F.from_json(column, "array<string>")).alias("_row")).select(F.try_to_timestamp(_object(F.col("_row"))["date"], F.lit("yyyy-MM-dd")).cast("date").alias("day"))
    return rows.withColumn("problem", F.when(F.col("day").isNull(), "no date")).distinct()


def universe(spec: str, named: dict[str, list[str]]) -> list[str]:
    """The symbols of a named set, or of a comma list."""
    symbols = named[spec] if spec in named else [s.strip() for s in spec.split(",") if s.strip()]
    if not symbols:
        raise ValueError("empty universe")
    return list(symbols)


def _finite(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _finite(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_finite(c[f.name], f.dataType).alias(f.name) for f in kind)))
    return c


def report_rows(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text (``value``): numbers that are not finite, at any depth, are null, and nulls are written."""
    clean = rows.select(*(_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema))
    return clean.select(F.to_json(F.struct(*(f"`{c}`" for c in clean.columns)), {"ignoreNullFields": "false"}).alias("value"))
