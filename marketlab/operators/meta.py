"""Meta-labelling: what a strategy's own trades say about when to trust its signals.

Every trade has the features of its decision (a map) and its net return. A classifier of boosted trees learns the chance that a trade wins, in
purged folds: a trade is scored by a model that saw neither it nor its neighbours. If the trades above some chance would have had a positive,
better and significant mean, the strategy gets a filtered version of itself, which begins as a challenger.

All of a strategy's trades are learned from, unless ``most`` asks for the last ones alone. No task needs them all: they are put in order by ranges,
limits of bins come from sums by value, and trades with the same bins are added up before each fold of a strategy is fitted in a task of its own. A row a
strategy (its features, limits and trees) passes through the driver and goes to where the trades lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window as W

from marketlab.functions import boosting
from marketlab.operators import stats
from marketlab.sources.store import settled

# Names of levels and clocks, which say when a trade was made and not what the market looked like.
LEVELS = r"^(ts|bars_seen|open|high|low|close|volume|ema_fast|ema_slow|rolling_mean|prior_high|atr|macd.*|(sma|ema|high|low|prev_high|prev_low)_\d+)$"


@dataclass(frozen=True)
class Config:
    least: int = 60
    most: int | None = None
    folds: int = 5
    embargo: int = 2
    thresholds: tuple[float, ...] = (0.45, 0.5, 0.55, 0.6, 0.65)
    least_kept: int = 20
    alpha: float = 0.05
    seed: int = 7
    top: int = 8


def _values(context: Column, features: Column, missing: Column) -> Column:
    """The context's values of the features, in order, and those of ``missing`` where there is none or none that is finite; each is looked up once."""
    found = F.transform(F.coalesce(features, F.expr("cast(array() as array<string>)")), lambda name: F.try_element_at(context, name))
    return F.zip_with(found, missing, lambda v, m: F.coalesce(_finite(v), m))


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def _picked(values: DataFrame, keys: list[str], weights: list[str], parts: int, share: str) -> DataFrame:
    """keys, k (of the weight) and ``limits``: NumPy's quantiles 1 / parts to (parts - 1) / parts of a value that comes ``weights[k]`` times; share: prefix of the columns of their totals."""
    over = W.partitionBy(*keys).orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    rows = values.select(*keys, "value", *(F.struct(F.lit(k).alias("k"), F.sum(w).over(over).alias("to"), F.col(w).alias("own"), (F.col(f"{share}{k}") - 1).alias("top")).alias(f"_w{k}") for k, w in enumerate(weights)))
    rows = rows.select(*keys, "value", F.explode(F.filter(F.array(*(f"_w{k}" for k in range(len(weights)))), lambda w: (w["own"] > 0) & (w["top"] > 0))).alias("w"))
    # Quantile i lies between the sorted values at floor(top i / parts) and the next one; this value stands at the places from ``at`` to before ``to``.
    first = lambda place: F.greatest(F.lit(0).cast("long"), F.ceil(F.greatest(place, F.lit(0)) * parts / F.col("top")))
    rows = rows.select(*keys, "value", "w.k", "w.top", F.col("w.to").alias("to"), (F.col("w.to") - F.col("w.own")).alias("at"))
    inside = lambda back: F.sequence(F.greatest(F.lit(1).cast("long"), first(F.col("at") - back)), F.least(F.lit(parts - 1).cast("long"), first(F.col("to") - back) - 1))
    some = lambda back: F.greatest(F.lit(1).cast("long"), first(F.col("at") - back)) <= F.least(F.lit(parts - 1).cast("long"), first(F.col("to") - back) - 1)
    spots = F.concat(*(F.when(some(back), F.transform(inside(back), lambda i: F.struct(i.alias("i"), F.lit(back).alias("back")))).otherwise(F.expr("cast(array() as array<struct<i:bigint,back:int>>)")) for back in (0, 1)))
    found = rows.where(some(0) | some(1)).select(*keys, "k", "top", "value", F.explode(spots).alias("s")).groupBy(*keys, "k", F.col("s.i").alias("i")).agg(F.max("top").alias("top"), F.min(F.when(F.col("s.back") == 0, F.col("value"))).alias("lo"), F.max(F.when(F.col("s.back") == 1, F.col("value"))).alias("hi"))
    t = (F.col("top") * F.col("i") % parts) / F.lit(float(parts))
    gap = F.col("hi") - F.col("lo")
    limit = F.when(t >= 0.5, F.col("hi") - gap * (1 - t)).otherwise(F.col("lo") + gap * t)
    return found.groupBy(*keys, "k").agg(F.array_sort(F.array_distinct(F.collect_list(F.coalesce(limit, "lo")))).alias("limits"))


def _known(own: DataFrame) -> DataFrame:
    """strategy, ``features`` and their ``_medians``, by name; a row a strategy."""
    values = own.select("strategy", F.explode("context").alias("name", "value")).where(~F.col("name").rlike(LEVELS))
    counts = settled(values.groupBy("strategy", "name", _finite(F.col("value").cast("double")).alias("value")).agg(F.count("*").alias("n")), "values")
    totals = counts.groupBy("strategy", "name").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("t0"))
    seen = counts.where("value is not null").join(F.broadcast(totals), ["strategy", "name"])
    middle = _picked(seen, ["strategy", "name"], ["n"], 2, "t").select("strategy", "name", F.col("limits")[0].alias("median"))
    single = seen.where("t0 = 1").select("strategy", "name", F.col("value").alias("median"))
    medians = totals.select("strategy", "name").join(F.broadcast(middle.unionByName(single)), ["strategy", "name"], "left").withColumn("median", F.coalesce("median", F.lit(0.0)))
    sorted_ = medians.groupBy("strategy").agg(F.sort_array(F.collect_list(F.struct("name", "median"))).alias("_m"))
    return settled(sorted_.select("strategy", F.col("_m.name").alias("features"), F.col("_m.median").alias("_medians")), "known")


def _ordered(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The rows with ``i``, a strategy's row number from 0 in the order given, and ``n``, the number of its rows; dealt by ranges of the order, and written once."""
    keys = ("strategy", *order)
    # The number of a row holds its partition and its place in that.
    rows = settled(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    ranges = rows.groupBy("strategy", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    whole = W.partitionBy("strategy")
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    ranges = ranges.select("strategy", "_part", (before - F.col("_from")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    ranges = F.broadcast(ranges.withColumnRenamed("strategy", "_s"))
    return rows.join(ranges, F.col("strategy").eqNullSafe(F.col("_s")) & (part == F.col("_part"))).withColumn("i", F.col("_at") + F.col("_shift")).drop("_s", "_part", "_at", "_shift")


def examples(trips: DataFrame, cfg: Config = Config()) -> DataFrame:
    """strategy, i (from 0, by exit), n (the strategy's number of trades), net_return, ``features`` (usable names in order) and ``x`` (their values, missing ones replaced by the strategy's median, or 0).

    trips: strategy, exit_ts, seq, net_return, context (map of name to value); trips without a context or return are left out.
    """
    own = trips.where("context is not null and net_return is not null").select("strategy", "exit_ts", "seq", "net_return", "context")
    if cfg.most is not None:  # the last of each share of a strategy's trades first, so that no task sorts all of them
        back = lambda *keys: F.row_number().over(W.partitionBy("strategy", *keys).orderBy(F.desc("exit_ts"), F.desc("seq")))
        own = own.withColumn("_share", F.pmod(F.xxhash64("exit_ts", "seq"), F.lit(64))).withColumn("_back", back("_share")).where(F.col("_back") <= cfg.most)
        own = own.withColumn("_back", back()).where(F.col("_back") <= cfg.most).drop("_back", "_share")
    known = F.broadcast(_known(own))
    rows = own.join(known, "strategy", "left").withColumn("x", _values(F.col("context"), F.col("features"), F.coalesce("_medians", F.expr("cast(array() as array<double>)"))))
    rows = _ordered(rows.select("strategy", "exit_ts", "seq", "net_return", "x"), ("exit_ts", "seq")).join(known.drop("_medians"), "strategy", "left")
    return rows.select("strategy", "i", "n", "net_return", F.coalesce("features", F.expr("cast(array() as array<string>)")).alias("features"), "x")


def usable(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """strategy, n_trades, and ``why``, the reason to learn nothing from it (null if there is none)."""
    g = rows.groupBy("strategy").agg(F.count("*").alias("n_trades"), F.max(F.size("features")).alias("_f"), F.count(F.when(F.col("net_return") > 0, 1)).alias("_w"))
    why = F.when(F.col("n_trades") < cfg.least, F.format_string(f"only %d trades (< {cfg.least})", "n_trades")).when(F.col("_f") == 0, "no usable features").when((F.col("_w") == 0) | (F.col("_w") == F.col("n_trades")), "all trades have the same outcome")
    return g.select("strategy", "n_trades", why.alias("why"))


def _fold_rows(rows: DataFrame, cfg: Config) -> DataFrame:
    """A row for each trade and fold k it is in, and part (train or test); fold -1 trains on all."""
    folds = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(cfg.folds - 1)))).withColumn("part", F.when(_tests(F.col("k"), cfg), "test").when(_trains(F.col("k"), cfg), "train")).where("part is not null")
    return folds.unionByName(rows.withColumns({"k": F.lit(-1), "part": F.lit("train")}))


def _from(k: Column | int, cfg: Config) -> Column:
    return F.floor(F.col("n") * k / cfg.folds)


def _tests(k: Column, cfg: Config) -> Column:
    return (F.col("i") >= _from(k, cfg)) & (F.col("i") < _from(k + 1, cfg))


def _trains(k: Column, cfg: Config) -> Column:
    return (F.col("i") < _from(k, cfg) - cfg.embargo) | (F.col("i") >= _from(k + 1, cfg) + cfg.embargo)


def _limits(rows: DataFrame, cfg: Config) -> DataFrame:
    """strategy, k, and ``limits``: of each feature in order, those of its bins among fold k's training trades."""
    parts = [-1, *range(cfg.folds)]
    size = lambda k: F.col("n") if k < 0 else F.col("n") - F.least(F.col("n"), _from(k + 1, cfg) + cfg.embargo) + F.greatest(F.lit(0), _from(k, cfg) - cfg.embargo)
    taken = lambda k: F.lit(1) if k < 0 else _trains(F.lit(k), cfg).cast("int")
    values = rows.select("strategy", "n", *(taken(k).alias(f"_t{j}") for j, k in enumerate(parts)), F.posexplode("x").alias("f", "value"))
    counts = values.groupBy("strategy", "f", "value").agg(F.max("n").alias("n"), *(F.sum(f"_t{j}").alias(f"w{j}") for j in range(len(parts))))
    counts = counts.withColumns({f"s{j}": size(k) for j, k in enumerate(parts)})
    limits = _picked(counts, ["strategy", "f"], [f"w{j}" for j in range(len(parts))], boosting.BINS, "s")
    return limits.groupBy("strategy", (F.col("k") - 1).alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "limits"))), lambda s: s["limits"]).alias("limits"))


#: Trades of one task that are added up together.
TOGETHER = 1 << 18


def models(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """strategy, k, base, trees, gain of every fold's training trades, and of all (k = -1); folds that train on one outcome only have none."""
    spark, kind = rows.sparkSession, rows.schema["strategy"].dataType.simpleString()
    rows = rows.select("strategy", "i", "n", "net_return", "x")
    # The limits of every strategy's bins: 31 numbers a feature and fold.
    limits = spark.sparkContext.broadcast({(r["strategy"], r["k"]): [np.array(e) for e in r["limits"]] for r in _limits(rows, cfg).collect()})

    def add_up(batches):
        def summed(held):
            t = pa.Table.from_batches(held).combine_chunks()
            coded = t.column("strategy").chunk(0).dictionary_encode()
            of, x = coded.indices.to_numpy(), t.column("x").chunk(0)
            i, n, y = (t.column(c).to_numpy() for c in ("i", "n", "won"))
            for at, strategy in enumerate(coded.dictionary.to_pylist()):
                own = np.flatnonzero(of == at)
                values = x.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                for k in (-1, *range(cfg.folds)):
                    lo, hi = n[own] * k // cfg.folds - cfg.embargo, n[own] * (k + 1) // cfg.folds + cfg.embargo
                    train = np.ones(len(own), bool) if k < 0 else (i[own] < lo) | (i[own] >= hi)
                    if train.any() and (strategy, k) in limits.value:
                        codes, counts = boosting.cells(boosting.encode(values[train], limits.value[strategy, k]), y[own][train])
                        m, d = codes.shape
                        cell = pa.BinaryArray.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(0, (m + 1) * d, d, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])
                        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(np.full(m, at))), pa.array(np.full(m, k, np.int32)), cell, pa.array(counts[:, 0]), pa.array(counts[:, 1])], ["strategy", "k", "cell", "lost", "won"])

        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= TOGETHER:
                yield from summed(held)
                held, size = [], 0
        if size:
            yield from summed(held)

    out = to_arrow_schema(_parse_datatype_string(schema := f"strategy {kind}, k int, base double, trees array<{boosting.TREE}>, gain array<double>"))

    def train(table: pa.Table) -> pa.Table:
        strategy, k = table.column("strategy")[0].as_py(), table.column("k")[0].as_py()
        edges, counts = limits.value[strategy, k], np.column_stack([table.column("lost").to_numpy(), table.column("won").to_numpy()])
        if not counts.sum(0).all():
            return out.empty_table()
        codes = np.concatenate([np.frombuffer(c.buffers()[2], np.uint8)[c.offset * len(edges) : (c.offset + len(c)) * len(edges)] for c in table.column("cell").chunks if len(c)]).reshape(-1, len(edges))
        order = np.lexsort(codes.T[::-1])  # so that the draws don't depend on how cells arrive
        base, trees, gain = boosting.fit_cells(codes[order], counts[order], edges, cfg.seed)
        names = ("f", "t", "lf", "lt", "rf", "rt", "v")
        return pa.Table.from_pylist([{"strategy": strategy, "k": k, "base": base, "trees": [dict(zip(names, t)) for t in trees], "gain": gain.tolist()}], out)

    won = (F.col("net_return") > 0).cast("double").alias("won")
    cells = rows.select("strategy", F.col("i").cast("long").alias("i"), F.col("n").cast("long").alias("n"), won, "x").mapInArrow(add_up, f"strategy {kind}, k int, cell binary, lost long, won long")
    # The models are dealt out here, as adaptive execution puts their few cells into one task.
    cells = cells.groupBy("strategy", "k", "cell").agg(F.sum("lost").alias("lost"), F.sum("won").alias("won")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "strategy", "k")
    return cells.groupBy("strategy", "k").applyInArrow(train, schema)


def _models_of(fitted: DataFrame) -> dict:
    return {(r["strategy"], r["k"]): (r["base"], r["trees"]) for r in fitted.select("strategy", "k", "base", "trees").collect()}


def out_of_fold(rows: DataFrame, fitted: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Each trade with ``p`` from the model of its own fold, which did not see it; null where that fold has no model."""
    own = _fold_rows(rows, cfg).where("part = 'test'")
    return own.select("strategy", "i", "k", "net_return", boosting.chance(rows.sparkSession, _models_of(fitted.where("k >= 0")), [F.col("strategy"), F.col("k")], F.col("x")).alias("p"))


def scan(scored: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The best threshold of each strategy: threshold, kept, kept_fraction, ev_all, ev_kept and ``p_value``, corrected for the number of thresholds.

    scored: strategy, net_return, p. Thresholds that keep fewer than ``least_kept`` trades are out; without any left, only ev_all is set.
    """
    tried = scored.where("p is not null").withColumn("threshold", F.explode(F.array(F.lit(None).cast("double"), *map(F.lit, cfg.thresholds)))).where("threshold is null or p >= threshold")
    found = settled(stats.payoffs(tried, "strategy", "threshold"), "payoffs")  # a row a strategy and threshold, and one without
    whole = found.where("threshold is null").select("strategy", F.col("n").alias("_n"), F.col("mean").alias("ev_all"))
    tests = stats.mean_test(found.where((F.col("n") >= cfg.least_kept) & F.col("threshold").isNotNull()))
    best = tests.withColumn("_k", F.row_number().over(W.partitionBy("strategy").orderBy(F.round("mean", 12).desc(), "threshold"))).where("_k = 1")
    out = whole.join(best.select("strategy", "threshold", F.col("n").alias("kept"), F.col("mean").alias("ev_kept"), F.least(F.lit(1.0), F.col("p") * len(cfg.thresholds)).alias("p_value")), "strategy", "left")
    return out.select("strategy", "threshold", "kept", (F.col("kept") / F.col("_n")).alias("kept_fraction"), "ev_all", "ev_kept", "p_value")


def digest(*parts: str) -> Column:
    """A hash by which a stored model is known again."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


MODEL = ("features", "threshold", "base", "trees")


def learn(trips: DataFrame, cfg: Config = Config()) -> DataFrame:
    """A row a strategy: accepted, reason, n_trades, the scan's figures, ``importance`` of the best features, and the model with its ``digest``."""
    rows = examples(trips, cfg)
    state = settled(usable(rows, cfg), "usable")
    ready = rows.join(F.broadcast(state.where("why is null").select("strategy")), "strategy", "left_semi")
    fitted = settled(models(ready, cfg), "models")
    found = settled(scan(out_of_fold(ready, fitted, cfg), cfg), "scan")
    named = settled(rows.groupBy("strategy").agg(F.first("features").alias("features")), "features")
    weights = F.sort_array(F.arrays_zip(F.transform("gain", lambda g: -g).alias("w"), F.col("features").alias("name")))
    importance = F.transform(F.slice(weights, 1, cfg.top), lambda s: F.struct(s["name"].alias("name"), (-s["w"]).alias("share")))
    final = fitted.where("k = -1").join(named, "strategy").select("strategy", "features", "base", "trees", importance.alias("importance"))
    out = state.join(found, "strategy", "left").join(final, "strategy", "left")
    c = F.col
    sure = (c("ev_kept") > 0) & (c("ev_kept") > c("ev_all")) & (c("p_value") < cfg.alpha)
    reason = (
        F.when(c("why").isNotNull(), c("why")).when(c("threshold").isNull(), "filter keeps too few trades").when(sure, "filtered trades beat the unfiltered strategy out of fold").when(c("ev_kept") <= 0, "even the best filter keeps a negative expected value")
        .when(c("ev_kept") <= c("ev_all"), "the filter does not improve on taking every signal").otherwise(F.format_string("improvement not significant (p=%.3f)", "p_value"))
    )
    out = out.withColumns({"accepted": F.coalesce(sure, F.lit(False)) & c("why").isNull(), "reason": reason, "digest": F.when(c("trees").isNotNull() & c("threshold").isNotNull(), digest(*MODEL))})
    return out.select("strategy", "accepted", "reason", "n_trades", "threshold", "kept", "kept_fraction", "ev_all", "ev_kept", "p_value", "importance", *(c for c in MODEL if c != "threshold"), "digest")


def filtered(signals: DataFrame, learned: DataFrame) -> DataFrame:
    """Signals (with strategy and context) of the accepted filters' versions: ``strategy~meta``, kept where the chance ``p_win`` reaches the threshold.

    Missing features count as 0. A model that does not match its digest raises an error.
    """
    checked = F.when(digest(*MODEL) == F.col("digest"), F.col("trees")).otherwise(F.raise_error(F.lit("a model does not match its digest")).cast(f"array<{boosting.TREE}>"))
    # A model a strategy: each is checked once, and sent to where the signals lie.
    models_ = {(r["strategy"],): (r["base"], r["trees"]) for r in learned.where("accepted").select("strategy", "base", checked.alias("trees")).collect()}
    rows = signals.join(F.broadcast(learned.where("accepted").select("strategy", "features", "threshold")), "strategy")
    x = _values(F.col("context"), F.col("features"), F.transform("features", lambda f: F.lit(0.0)))
    scored = rows.withColumns({"p_win": boosting.chance(signals.sparkSession, models_, [F.col("strategy")], x), "strategy": F.concat("strategy", F.lit("~meta"))})
    return scored.where("p_win >= threshold").select(*signals.columns, "p_win")
