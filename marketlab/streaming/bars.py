"""Event-time bars on streams of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.sources.store import shared_path


def stream_bars(trades: DataFrame, rule: str, delay: str = "0 seconds") -> DataFrame:
    """Tumbling bars; one is final once a trade at or after its end plus ``delay`` has come, and later rows of it are dropped."""
    order = F.struct("ts", "seq")
    done = trades.withWatermark("ts", delay).groupBy("symbol", F.window("ts", rule).alias("bar")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("qty").alias("volume"), F.sum(F.when(~F.col("buyer_is_maker"), F.col("qty")).otherwise(0.0)).alias("taker_buy_volume")
    )
    return done.select("symbol", F.col("bar.start").alias("ts"), "open", "high", "low", "close", "volume", "taker_buy_volume")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what its source holds now, into a table of the shared folder, and read that."""
    spark: SparkSession = stream.sparkSession
    path = shared_path(spark, name)
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
