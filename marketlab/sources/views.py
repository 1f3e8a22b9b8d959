"""Market-shaped views of the given tables: trades and quotes from events, hourly and daily bars, headlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.operators.bars import resample_trades


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, price, qty, buyer_is_maker, seq from the event table."""
    return as_trades(table(spark, sf_dir, "events"))


def trade_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of the event files."""
    return as_trades(spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet"))


def as_trades(e: DataFrame) -> DataFrame:
    qty = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0)) + 1
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") + 1).alias("price"), qty.alias("qty"), (F.col("event_id") % 2 == 0).alias("buyer_is_maker"), F.col("event_id").alias("seq"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, bid, bid_qty, ask, ask_qty, seq around each trade."""
    t = trades(spark, sf_dir)
    size = (F.col("seq") % 10 + 1).cast("double")
    return t.select("symbol", "ts", (F.col("price") * 0.9995).alias("bid"), size.alias("bid_qty"), (F.col("price") * 1.0005).alias("ask"), size.alias("ask_qty"), "seq")


def rough_quotes(trades_: DataFrame) -> DataFrame:
    """Quotes around trades, some missing, some late by a second, crossed, locked, without a bid or without any size."""
    c, seq = F.col, F.col("seq")
    late = F.when(seq % 5 == 0, F.expr("interval 1 second")).otherwise(F.expr("interval 0 seconds"))
    over = F.when(seq % 11 == 0, 0.999).when(seq % 11 == 5, 0.9995).otherwise(1.0005)
    bid = F.when(seq % 97 == 1, 0.0).otherwise(c("price") * 0.9995)
    q = trades_.where(seq % 7 != 3)
    return q.select("symbol", (c("ts") + late).alias("ts"), bid.alias("bid"), (seq % 10).cast("double").alias("bid_qty"), (c("price") * over).alias("ask"), (seq * 7 % 10).cast("double").alias("ask_qty"), "seq")


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_trades(trades(spark, sf_dir), "1 hour").withColumn("timeframe", F.lit("1h"))


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of (return flag, line status) from line items; ties in a day go by six columns."""
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = li.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"), price.alias("price"), F.col("l_quantity").cast("double").alias("qty"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("k"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity").cast("double")).otherwise(0.0).alias("taker"),
    )
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("price", "k").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "k").alias("close"), F.sum("qty").alias("volume"), F.sum("taker").alias("taker_buy_volume")
    ).withColumn("timeframe", F.lit("1d"))


def bar_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols that have daily bars."""
    return table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("symbol")).distinct()


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, created_at, headline (the whole text) and symbols: documents dated by the event of the same number."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    joined = d.join(e, d["doc_id"] == e["event_id"])
    return joined.select(F.col("doc_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), F.col("text").alias("headline"), F.array("event_type").alias("symbols"))
