"""What a study says about trades: date means, costs, stability, resampling, benchmark, rankings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: Simulations that one task row draws.
SIMS_A_BLOCK = 500


def date_means(trades: DataFrame, *keys: str) -> DataFrame:
    """One observation per entry time: the mean net return of the trades entered then."""
    return trades.groupBy(*keys, "entry_ts").agg(F.avg("net_return").alias("net_return"), F.count("*").alias("n"))


def cost_analysis(trades: DataFrame, *keys: str) -> DataFrame:
    return trades.groupBy(*keys).agg(F.avg("gross_return").alias("gross_ev"), F.avg("net_return").alias("net_ev"), F.avg(F.col("gross_return") - F.col("net_return")).alias("mean_cost"))


def stability(metrics: DataFrame, *keys: str) -> DataFrame:
    """How a rule's variants agree; metrics has ``ev``, a row a variant."""
    out = metrics.groupBy(*keys).agg(
        F.count("*").alias("n_variants"), F.avg((F.col("ev") > 0).cast("double")).alias("fraction_positive"), F.median("ev").alias("median_ev"), F.max("ev").alias("best_ev"),
        (F.stddev_pop("ev") / (F.abs(F.avg("ev")) + 1e-12)).alias("dispersion"),
    )
    share = F.when((F.col("median_ev") > 0) & (F.col("best_ev") > 0), F.col("median_ev") / F.col("best_ev")).otherwise(0.0)
    return out.withColumn("score", F.col("fraction_positive") * share)


def monte_carlo(trades: DataFrame, *keys: str, sims: int = 5000, seed: int = 7, loss: float = -0.2) -> DataFrame:
    """Bootstrap of each group's trades: percentiles of the final return and of the worst drawdown, and their risks.

    Simulations are drawn in blocks, each with a generator seeded by a hash of seed, group and block, so reruns and any partitioning
    agree; a group's trades are one row a block. Groups without trades have no row.
    """
    own = trades.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("entry_ts", "exit_ts", "net_return"))).alias("_t")).select(*keys, F.transform("_t", lambda t: t["net_return"]).alias("_r"))
    blocks = own.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((sims - 1) // SIMS_A_BLOCK))))
    blocks = blocks.withColumn("_seed", F.xxhash64(F.lit(seed), *keys, "_block")).withColumn("_sims", F.least(F.lit(SIMS_A_BLOCK), F.lit(sims) - F.col("_block") * SIMS_A_BLOCK))
    schema = T.StructType([*blocks.select(*keys).schema.fields, T.StructField("final", T.DoubleType()), T.StructField("drawdown", T.DoubleType())])

    def draw(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.column("_r")[k].values.to_numpy(zero_copy_only=False)
                rng, left = np.random.default_rng(batch.column("_seed")[k].as_py() % 2**63), batch.column("_sims")[k].as_py()
                while left:
                    m = min(left, max(1, 1_000_000 // len(r)))
                    # In logarithms: long runs of gains would overflow.
                    with np.errstate(divide="ignore", over="ignore"):
                        grown = np.cumsum(np.log1p(np.maximum(r, -1.0))[rng.integers(0, len(r), (m, len(r)))], axis=1)
                        worst = np.expm1(grown - np.maximum(np.maximum.accumulate(grown, axis=1), 0.0)).min(axis=1)
                        final = np.expm1(grown[:, -1])
                    same = [pa.array([batch.column(c)[k].as_py()] * m, batch.schema.field(c).type) for c in keys]
                    yield pa.record_batch([*same, pa.array(final), pa.array(worst)], names=[*keys, "final", "drawdown"])
                    left -= m

    ends = blocks.repartition(*keys, "_block").select(*keys, "_r", "_seed", "_sims").mapInArrow(draw, schema)
    return ends.groupBy(*keys).agg(
        *(F.percentile("final", q / 100).alias(f"final_p{q}") for q in (5, 50, 95)), F.percentile("drawdown", 0.5).alias("drawdown_p50"), F.percentile("drawdown", 0.05).alias("drawdown_p95"),
        F.avg((F.col("final") < 0).cast("double")).alias("p_loss"), F.avg((F.col("drawdown") < loss).cast("double")).alias("p_drawdown"),
    )


def buy_and_hold(quotes: DataFrame, cash: float) -> DataFrame:
    """Value of ``cash`` spread evenly over the symbols at their first mid and held to their last; one row."""
    mid, order = (F.col("bid") + F.col("ask")) / 2, F.struct("ts", "seq")
    ratio = quotes.groupBy("symbol").agg((F.max_by(mid, order) / F.min_by(mid, order)).alias("ratio"))
    return ratio.agg((F.avg("ratio") * cash).alias("value"), F.count("*").alias("symbols"))


def feed_gaps(events: DataFrame, seconds: float = 10, key: str = "symbol") -> DataFrame:
    """Where a feed was silent for longer than ``seconds``: key, from, seconds."""
    w = W.partitionBy(key).orderBy("ts")
    silent = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1e6
    return events.select(key, F.lag("ts").over(w).alias("from_ts"), silent.alias("silent_s")).where(F.col("silent_s") > seconds)


def latest_headlines(headlines: DataFrame, universe: list[str], n: int) -> DataFrame:
    """One row an id (the newest), those on the universe first, then the newest, ties by id; n rows."""
    once = headlines.withColumn("_k", F.row_number().over(W.partitionBy("id").orderBy(F.desc("created_at")))).where("_k = 1").drop("_k")
    return once.orderBy(F.desc(F.arrays_overlap("symbols", F.array(*map(F.lit, universe)))), F.desc("created_at"), "id").limit(n)
