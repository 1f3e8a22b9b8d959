"""Books of trades: profit and loss, streaks, equity, gates, reviews, and ordered reports of the latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

DAY_S = 86_400


def latest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The n latest rows by the given columns."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n)


def activity_feed(sources: dict[str, tuple[DataFrame, int]], n: int = 40) -> DataFrame:
    """(ts, seq, kind, text): the latest rows of each source up to its own limit, merged, newest first."""
    out = None
    for kind, (rows, most) in sources.items():
        own = latest(rows.select("ts", "seq", F.lit(kind).alias("kind"), "text"), most, "ts", "seq")
        out = own if out is None else out.unionByName(own)
    return out.orderBy(F.desc("ts"), "kind", F.desc("seq")).limit(n)


def realised(trips: DataFrame, *keys: str) -> DataFrame:
    return trips.groupBy(*keys).agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"), F.count("*").alias("trips"))


def weekly_pnl(trips: DataFrame, now: Column, weeks: int = 4) -> DataFrame:
    """P&L of the ``weeks`` seven-day spans that end at ``now``: week 0 is the last one."""
    week = F.floor((F.unix_micros(now) - F.unix_micros("exit_ts") - 1) / (7 * DAY_S * 1_000_000))
    return trips.withColumn("week", week.cast("int")).where(F.col("week").between(0, weeks - 1)).groupBy("week").agg(F.sum("pnl").alias("pnl"), F.count("*").alias("trips"))


def losing_streaks(trips: DataFrame, *keys: str, order: tuple[str, ...] = ("exit_ts", "seq")) -> DataFrame:
    """Adds ``consecutive_losses``: trips without profit in a row, up to and with this one.

    Trips are counted by day of the first of ``order``, a time; what a day leaves open is carried on by a row a day, so that no task holds all trips of a key.
    """
    rows = trips.withColumn("_day", F.to_date(order[0]))
    inside = lambda *more: W.partitionBy(*keys, "_day", *more).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    lost = F.when(F.col("pnl") <= 0, 1).otherwise(0).cast("long")
    rows = rows.withColumn("_wins", F.sum(F.when(F.col("pnl") > 0, 1).otherwise(0)).over(inside()))
    days = rows.groupBy(*keys, "_day", "_wins").agg(F.sum(lost).alias("_n")).groupBy(*keys, "_day").agg(F.max_by("_n", "_wins").alias("_n"), (F.max("_wins") > 0).cast("int").alias("_won"))
    by_day = lambda *more: W.partitionBy(*keys, *more).orderBy("_day")
    days = days.withColumn("_island", F.sum("_won").over(by_day())).withColumn("_n", F.sum("_n").over(by_day("_island"))).withColumn("_carried", F.coalesce(F.lag("_n").over(by_day()), F.lit(0)))
    days = days.select(*(F.col(k).alias(f"_of_{k}") for k in (*keys, "_day")), "_carried")
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, "_day")]
    streak = F.sum(lost).over(inside("_wins"))
    found = rows.withColumn("_streak", streak).join(days, same, "left")
    return found.withColumn("consecutive_losses", F.col("_streak") + F.when(F.col("_wins") == 0, F.col("_carried")).otherwise(0)).select(*trips.columns, "consecutive_losses")


def equity_state(equity: DataFrame, *keys: str) -> DataFrame:
    """Adds ``day_start`` (equity before the UTC day), ``peak``, ``drawdown`` and ``daily_pnl`` (0 where there is no day before)."""
    w = W.partitionBy(*keys).orderBy("ts")
    day = F.to_date("ts")
    rows = equity.withColumn("_day", day).withColumn("_before", F.lag("equity").over(w))
    start = F.first("_before").over(W.partitionBy(*keys, "_day").orderBy("ts").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumns({"day_start": start, "peak": F.max("equity").over(w.rowsBetween(W.unboundedPreceding, 0))})
    return rows.withColumns({"drawdown": F.col("equity") / F.col("peak") - 1, "daily_pnl": F.coalesce(F.col("equity") / F.nullif("day_start", F.lit(0.0)) - 1, F.lit(0.0))}).drop("_day", "_before")


def session_factors(equity: DataFrame, starts: DataFrame, gap_s: float = 3600.0, key: str = "run_id") -> DataFrame:
    """Growth of equity and benchmark from sample to sample; steps over a session start, a long gap or a missing benchmark are left out."""
    marks = starts.select(key, "ts", F.lit(0).alias("_kind")).unionByName(equity.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy("ts", "_kind")
    seen = F.count(F.when(F.col("_kind") == 0, 1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = marks.withColumn("_session", seen).where("_kind = 1")
    own = W.partitionBy(key).orderBy("ts")
    before = {c: F.lag(c).over(own) for c in ("ts", "equity", "buy_hold", "_session")}
    rows = rows.withColumns({f"_p_{c}": v for c, v in before.items()})
    fine = (F.col("_session") == F.col("_p__session")) & (F.unix_micros("ts") - F.unix_micros("_p_ts") <= gap_s * 1e6) & (F.col("_p_buy_hold") != 0) & (F.col("buy_hold") != 0) & (F.col("_p_equity") > 0)
    return rows.where(fine).select(key, "ts", (F.col("equity") / F.col("_p_equity")).alias("equity_factor"), (F.col("buy_hold") / F.col("_p_buy_hold")).alias("benchmark_factor"))


def growth(factors: DataFrame, key: str = "run_id") -> DataFrame:
    """Growth of both and the deepest fall of equity below its peak (as a positive fraction), each run one row.

    Running sums of logarithms: factors are positive where equity is.
    """
    w = W.partitionBy(key).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    rows = factors.withColumn("_l", F.sum(F.log("equity_factor")).over(w)).withColumn("_p", F.greatest(F.lit(0.0), F.max("_l").over(w)))
    return rows.groupBy(key).agg((F.exp(F.sum(F.log("equity_factor"))) - 1).alias("strategy"), (F.exp(F.sum(F.log("benchmark_factor"))) - 1).alias("benchmark"), F.max(1 - F.exp(F.col("_l") - F.col("_p"))).alias("drawdown"), F.count("*").alias("steps"))


def incidents(samples: DataFrame, key: str, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """State changes of a mismatch: opened by the second bad sample in a row, closed by the first good one."""
    w = W.partitionBy(key).orderBy(*order)
    rows = samples.withColumn("_two", F.col("bad") & F.coalesce(F.lag("bad").over(w), F.lit(False)))
    # Open from the second bad sample until a good one: bad samples in a row keep it open.
    rows = rows.withColumn("_was", F.coalesce(F.lag("_two").over(w), F.lit(False)))
    change = F.when(F.col("_two") & ~F.col("_was"), "opened").when(~F.col("bad") & F.col("_was"), "closed")
    return rows.withColumn("change", change).where("change is not null").drop("_two", "_was")


def flips(evaluations: DataFrame, key: str, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Evaluations whose verdict ``ready`` differs from the one before."""
    before = F.lag("ready").over(W.partitionBy(key).orderBy(*order))
    return evaluations.withColumn("_before", before).where("_before is not null and _before <> ready").drop("_before")


def switch_tested(events: DataFrame, key: str = "run_id") -> DataFrame:
    """Was the kill switch turned on, and off again later?"""
    on, off = F.min(F.when(F.col("kind") == "kill_switch_on", F.struct("ts", "seq"))), F.max(F.when(F.col("kind") == "kill_switch_off", F.struct("ts", "seq")))
    return events.groupBy(key).agg(F.coalesce(on < off, F.lit(False)).alias("tested"))


def current_state(events: DataFrame, key: str, order: tuple[str, ...], *values: str) -> DataFrame:
    """The latest values of each key from an append-only log, and how many rows it has."""
    return events.groupBy(key).agg(*(F.max_by(v, F.struct(*order)).alias(v) for v in values), F.count("*").alias("changes"))


def transitions(events: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Rows whose status differs from the key's status before; the same status again is no event."""
    before = F.lag("status").over(W.partitionBy(key).orderBy(*order))
    return events.withColumn("from_status", before).where("from_status is null or from_status <> status")


def review(rules: DataFrame, forward: DataFrame, now: Column, min_edge: float = 40.0, min_confidence: float = 0.875, retire_n: int = 30, retire_p: float = 0.2, stale_days: float = 3.0) -> DataFrame:
    """What a review changes: retire for bad evidence, retire for no trades, promote, demote, in that order; rows without a change go.

    rules: rule, status, updated_at. forward: rule, n, edge_score, confidence, p_positive.
    """
    both = rules.join(forward.withColumnRenamed("rule", "_of"), F.col("rule") == F.col("_of"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fit = (F.coalesce("edge_score", F.lit(0.0)) >= min_edge) & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    stale = (F.col("n") == 0) & (F.unix_micros(now) - F.unix_micros("updated_at") > stale_days * DAY_S * 1e6)
    action = (
        F.when((F.col("n") >= retire_n) & (F.col("p_positive") < retire_p), F.struct(F.lit("retired").alias("to_status"), F.lit("bad evidence").alias("reason")))
        .when(stale, F.struct(F.lit("retired").alias("to_status"), F.lit("no signals").alias("reason")))
        .when((F.col("status") == "challenger") & fit, F.struct(F.lit("champion").alias("to_status"), F.lit("evidence suffices").alias("reason")))
        .when((F.col("status") == "champion") & ~fit, F.struct(F.lit("challenger").alias("to_status"), F.lit("evidence weakened").alias("reason")))
    )
    return both.where(F.col("status").isin("challenger", "champion")).withColumn("_a", action).where("_a is not null").select("rule", F.col("status").alias("from_status"), "_a.to_status", "_a.reason", "n")


def promotions(candidates: DataFrame, slots: DataFrame) -> DataFrame:
    """The best candidates by edge score, as many as there are free slots (one row, ``slots``)."""
    # Candidates are the few rules that passed a study; one ordered pass ranks them.
    ranked = candidates.withColumn("place", F.row_number().over(W.orderBy(F.desc("edge_score"), "rule")))
    return ranked.crossJoin(F.broadcast(slots)).where("place <= slots").drop("slots")


def blocked_episodes(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """Runs of bars with a signal that costs block; an episode counts once, however long."""
    w = W.partitionBy(key).orderBy("ts")
    begins = F.col("blocked") & ~F.coalesce(F.lag("blocked").over(w), F.lit(False))
    rows = bars.withColumn("_e", F.sum(begins.cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("blocked")
    return rows.groupBy(key, F.col("_e").alias("episode")).agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.count("*").alias("bars"))


def throttle(orders: DataFrame, key: str = "account", per_minute: int = 6, cooldown_s: float = 30.0) -> DataFrame:
    """Orders with ``accepted``: at most ``per_minute`` accepted ones in 60 seconds, and a pause for each symbol after one.

    Whether an order is accepted depends on earlier accepted ones, so orders stream through by account; state is a minute of them.
    """
    import pyarrow as pa

    rows = orders.withColumn("_at", F.unix_micros("ts"))

    def run(batches):
        account, recent, last = object(), [], {}
        for batch in batches:
            out = []
            for a, at, symbol in zip(*(batch.column(c).to_pylist() for c in (key, "_at", "symbol"))):
                if a != account:
                    account, recent, last = a, [], {}
                recent = [x for x in recent if at - x < 60_000_000]
                fine = len(recent) < per_minute and at - last.get(symbol, -(1 << 62)) >= cooldown_s * 1e6
                if fine:
                    recent.append(at)
                    last = {s: x for s, x in last.items() if at - x < cooldown_s * 1e6} | {symbol: at}
                out.append(fine)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "accepted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", accepted boolean"
    return rows.repartition(key).sortWithinPartitions(key, "_at", "seq").mapInArrow(run, schema).drop("_at")
