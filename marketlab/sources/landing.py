"""Tables that grow run by run in a shared folder: the tick log, days of bars, headlines, audit rows and study versions.

Every write may be repeated: days and micro-batches overwrite their own partitions, headlines and versions append only what is not there yet. So a run that was
lost half way is simply run again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at path, or an empty one where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _overwrite(rows: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that rows has, and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


# --- tick log


def write_ticks(ticks: DataFrame, path: str) -> None:
    """ticks (symbol, ts, seq, kind, ..) by day and symbol, in order; whole days replace what is there. Ranges of time split a hot symbol's day."""
    dated = ticks.withColumn("day", F.to_date("ts"))
    _overwrite(dated.repartitionByRange("day", "symbol", "ts").sortWithinPartitions("day", "symbol", "ts", "seq"), path, "day", "symbol")


def read_ticks(spark: SparkSession, path: str, start: dt.datetime, end: dt.datetime, symbols: list[str] | None = None) -> DataFrame:
    """Ticks from start up to, not at, end (UTC), in order of time and number; only the days and symbols asked for are read."""
    rows = spark.read.parquet(path).where(F.col("day").between(F.lit(start.date()), F.lit(end.date())) & (F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
    if symbols is not None:
        rows = rows.where(F.col("symbol").isin(symbols))
    return rows.drop("day").orderBy("ts", "seq", "kind")


def tick_summary(ticks: DataFrame) -> DataFrame:
    """n, first and last time by symbol and kind."""
    return ticks.groupBy("symbol", "kind").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# --- days of bars

DAYS = "day date, n long, complete boolean, at timestamp"


def known_days(spark: SparkSession, root: str) -> DataFrame:
    """What is known of every day that was ever asked for, as of the last time: n rows (0: a holiday), and whether it was over then."""
    marks = _read(spark, f"{root}/days", DAYS)
    return marks.groupBy("day").agg(F.max_by(F.struct("n", "complete"), F.struct("at", "complete")).alias("s")).select("day", "s.*")


def wanted_days(spark: SparkSession, root: str, first: dt.date, last: dt.date) -> DataFrame:
    """Weekdays from first to last that have not been landed complete: new ones, and the day that was still running."""
    span = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day")).where(F.weekday("day") < 5)
    return span.join(known_days(spark, root).where("complete"), "day", "left_anti")


def land_days(bars: DataFrame, root: str, days: DataFrame, now: dt.datetime) -> None:
    """Write the bars (with ts) of the given days and mark the days; one without bars that is over is kept as an empty day."""
    rows = bars.withColumn("day", F.to_date("ts")).join(days, "day", "left_semi")
    _overwrite(rows.repartitionByRange("day", "ts"), f"{root}/bars", "day")
    counts = rows.groupBy("day").agg(F.count("*").alias("n"))
    marks = days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.col("day") < F.lit(now.date())).alias("complete"), F.lit(now).alias("at"))
    marks.write.mode("append").parquet(f"{root}/days")


# --- headlines

BACKFILL, OVERLAP = dt.timedelta(days=22), dt.timedelta(minutes=10)


def covered(spark: SparkSession, root: str) -> tuple[dt.datetime, dt.datetime] | None:
    """From and until when headlines are complete."""
    r = _read(spark, f"{root}/coverage", "covered_from timestamp, covered_until timestamp").agg(F.min("covered_from").alias("a"), F.max("covered_until").alias("b")).first()
    return (r["a"], r["b"]) if r["b"] else None


def pull_from(spark: SparkSession, root: str, now: dt.datetime) -> dt.datetime:
    """Where the next pull begins: far back the first time, then a little before where the last one ended."""
    found = covered(spark, root)
    return found[1] - OVERLAP if found else now - BACKFILL


def land_headlines(pulled: DataFrame, root: str, since: dt.datetime, now: dt.datetime) -> None:
    """Append headlines (id, created_at, ..) whose id is new, then move the coverage on; of equal ids in one pull the newest stays."""
    spark = pulled.sparkSession
    newest = F.row_number().over(W.partitionBy("id").orderBy(F.desc("created_at")))
    once = pulled.where("id is not null").withColumn("_k", newest).where("_k = 1").drop("_k")
    once.join(_read(spark, f"{root}/headlines", pulled.schema).select("id"), "id", "left_anti").select(*pulled.columns).write.mode("append").parquet(f"{root}/headlines")
    spark.createDataFrame([(since, now)], "covered_from timestamp, covered_until timestamp").write.mode("append").parquet(f"{root}/coverage")


def once_on_stream(headlines: DataFrame, overlap: str = "10 minutes") -> DataFrame:
    """A stream of overlapping pulls with every headline once; ids are forgotten when they are older than the overlap."""
    return headlines.withWatermark("created_at", overlap).dropDuplicatesWithinWatermark(["id"])


# --- audit rows


def audit(stream: DataFrame, path: str, state: str):
    """Start writing a stream's rows below path, a partition a micro-batch, so that a batch that runs again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        land_batch(batch, path, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def land_batch(batch: DataFrame, path: str, number: int) -> None:
    _overwrite(batch.withColumn("batch", F.lit(number)), path, "batch")


def order_state(log: DataFrame) -> DataFrame:
    """Each order as its log leaves it: the last entry of kind ``order``, and over it the last ``fill``'s price, time and fee.

    log: run_id, order_id, ts, seq, kind, symbol, side, quantity, status, price, fee.
    """
    last = lambda kind, *cols: F.max_by(F.when(F.col("kind") == kind, F.struct(*cols)), F.when(F.col("kind") == kind, F.struct("ts", "seq")))
    # Dealt out by order before anything is sorted: sorts for partial results of whole files would take a task's memory.
    g = log.repartition("run_id", "order_id").groupBy("run_id", "order_id").agg(last("order", "symbol", "side", "quantity", "status").alias("o"), last("fill", "price", "ts", "fee").alias("f")).where("o is not null")
    filled = F.col("f").isNotNull()
    return g.select("run_id", "order_id", "o.symbol", "o.side", "o.quantity", F.when(filled, "FILLED").otherwise(F.col("o.status")).alias("status"), F.col("f.price").alias("fill_price"), F.col("f.ts").alias("fill_ts"), F.col("f.fee").alias("fee"))


# --- studies


def new_versions(specs: DataFrame, known: DataFrame) -> DataFrame:
    """strategy, version, hash, spec of the specs (strategy, spec) that no known version (strategy, version, hash) equals, numbered on from the largest."""
    hashed = specs.select("strategy", "spec", F.sha2("spec", 256).alias("hash")).dropDuplicates(["strategy", "hash"])
    fresh = hashed.join(known.select("strategy", "hash"), ["strategy", "hash"], "left_anti")
    most = known.groupBy("strategy").agg(F.max("version").alias("_most"))
    number = F.coalesce("_most", F.lit(0)) + F.row_number().over(W.partitionBy("strategy").orderBy("hash"))
    return fresh.join(most, "strategy", "left").select("strategy", number.cast("int").alias("version"), "hash", "spec")


def flat_study(verdicts: DataFrame, windows: DataFrame) -> dict[str, DataFrame]:
    """A study's verdicts and walk-forward windows as the tables they are kept in: strategies, backtests (a row in, a row out of sample) and walk_forward_runs."""
    c = F.col
    sample = lambda name, n, ev, p: F.struct(F.lit(name).alias("sample"), n.cast("long").alias("n_trades"), ev.alias("ev"), p.alias("p"))
    none = F.lit(None).cast("double")
    backtests = verdicts.select("symbol", "rule", c("selected").alias("variant"), "decision", F.inline(F.array(sample("IS", F.lit(None), none, c("is_p")), sample("OOS", c("oos_trades"), c("oos_ev"), c("oos_p")))))
    return {"strategies": verdicts.select("rule").distinct(), "backtests": backtests, "walk_forward_runs": windows.select("symbol", "rule", "k", "selected", "is_ev", "oos_ev", "oos_trades")}


# --- fingerprints


def _part(of: Column, at: int) -> Column:
    """Fifteen hex digits as a number."""
    return F.conv(F.substring(of, at, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(rows: DataFrame, columns: list[str], key: str = "symbol") -> DataFrame:
    """A hash of each key's rows that does not depend on their order or partitions, and that partial sums can be merged into; nulls differ from any text."""
    text = F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns))
    hashed = rows.select(key, F.md5(text).alias("h"))
    g = hashed.groupBy(key).agg(F.count("*").alias("n"), F.sum(_part(F.col("h"), 1)).alias("a"), F.sum(_part(F.col("h"), 17)).alias("b"))
    return g.select(key, "n", F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("fingerprint"))


def study_fingerprint(by_key: DataFrame, key: str = "symbol") -> DataFrame:
    """One hash of all keys' fingerprints."""
    return by_key.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", key, "fingerprint"))), "|"), 256).alias("fingerprint"), F.count("*").alias("keys"))
