"""Bars in files: a store by timeframe and symbol that takes valid bars only, and CSV files as users have them."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.operators.bars import violations
from marketlab.sources.payloads import OHLCV, _number

STORED = "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double"


def write_bars(bars: DataFrame, root: str) -> None:
    """Write bars (symbol, timeframe, ts, open .. volume); each (timeframe, symbol) among them replaces what the store had. Bars that break a rule: nothing is written.

    Ranges of time split a long history over tasks and files.
    """
    rows = bars.select("symbol", "timeframe", "ts", *(F.col(c).cast("double").alias(c) for c in OHLCV))
    broken = violations(rows.withColumn("symbol", F.concat_ws("/", "timeframe", "symbol"))).groupBy("rule").count().collect()
    if broken:
        raise ValueError("bars break rules: " + ", ".join(sorted(f"{r['rule']} ({r['count']})" for r in broken)))
    rows.repartitionByRange("timeframe", "symbol", "ts").sortWithinPartitions("timeframe", "symbol", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("timeframe", "symbol").parquet(root)


def _stored(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(STORED).parquet(root)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STORED)


def stored_symbols(spark: SparkSession, root: str, timeframe: str) -> DataFrame:
    """Symbols that the store has at a timeframe; files hold no column that is read for it."""
    return _stored(spark, root).where(F.col("timeframe") == timeframe).select("symbol").distinct()


def read_bars(spark: SparkSession, root: str, timeframe: str, symbols: list[str], start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """Bars of the symbols from start to end, both included; only their folders are read. A symbol that the store does not have is an error."""
    known = {r["symbol"] for r in stored_symbols(spark, root, timeframe).where(F.col("symbol").isin(symbols)).collect()}
    if absent := set(symbols) - known:
        raise FileNotFoundError(f"{timeframe}: {', '.join(sorted(absent))}")
    rows = _stored(spark, root).where((F.col("timeframe") == timeframe) & F.col("symbol").isin(symbols))
    for bound, op in ((start, "__ge__"), (end, "__le__")):
        if bound is not None:
            rows = rows.where(getattr(F.col("ts"), op)(F.lit(bound)))
    return rows.select("symbol", "timeframe", "ts", *OHLCV)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars of ``<symbol>_<timeframe>.csv`` files, or folders of parts by that name: symbol, timeframe, ts, open .. volume, problem.

    Each file has its own header: names in any case and order, further columns, and the time as ``timestamp``, or else ``date`` (UTC where it tells no zone).
    The header is found by its names, so a large file is split over tasks like any other.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    cells = lines.withColumn("_c", F.transform(F.split(F.regexp_replace("value", "^﻿", ""), ","), lambda x: F.regexp_replace(F.trim(x), '^"|"$', "")))
    names = F.transform("_c", F.lower)
    cells = cells.withColumn("_head", F.array_contains(names, "open") & F.array_contains(names, "close"))
    heads = cells.where("_head").groupBy("file").agg(F.min(names).alias("_names"))
    body = cells.where("not _head").join(heads, "file", "left")
    at = lambda name: F.try_element_at("_c", F.nullif(F.array_position("_names", name), F.lit(0)).cast("int"))
    time = F.when(F.array_contains("_names", "timestamp"), at("timestamp")).otherwise(at("date"))
    out = body.select(
        F.url_decode(F.regexp_extract("file", r"([^/]+)_[^_/]+\.csv(?:/[^/]*)?$", 1)).alias("symbol"), F.regexp_extract("file", r"_([^_/]+)\.csv(?:/[^/]*)?$", 1).alias("timeframe"), F.try_to_timestamp(time).alias("ts"), *(_number(at(c)).alias(c) for c in OHLCV), F.col("_names").isNull().alias("_bare")
    )
    missing = F.exists(F.array(*(F.col(c).isNull() for c in OHLCV)), lambda x: x)
    return out.withColumn("problem", F.when(F.col("_bare"), "no header").when(F.col("ts").isNull(), "no time").when(missing, "no number")).drop("_bare")
