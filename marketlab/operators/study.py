"""A research study as one plan over symbol x rule x variant x fold.

Trades of all variants in all folds are found once; the sweep, the choice of a variant, the frozen test on unseen bars, walk-forward,
resampling, regimes and the verdict are groupings and joins of that table, so no pair is researched by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marketlab.operators import research, stats
from marketlab.operators.validation import benjamini_hochberg
from marketlab.sources.store import settled

#: Bars in a year by timeframe (fixed values).
PERIODS_PER_YEAR = {"1d": 252, "1h": 252 * 7, "15m": 252 * 26, "5m": 252 * 78, "1min": 365 * 24 * 60, "5min": 365 * 24 * 12, "15min": 365 * 24 * 4}
#: Fewer bars than this make an error row of a symbol.
MIN_BARS = 600


def fold_bounds(bars: DataFrame, out_of_sample: float = 0.3, windows: int = 5, anchored: bool = True) -> DataFrame:
    """symbol, fold, lo, hi, n_bars: full, is, oos, and train_k and test_k of a walk-forward; rows from lo up to hi, from 0. Folds of less than two bars are left out."""
    n = F.col("n").cast("double")
    cut = lambda k: F.floor(F.lit(k) * (n / (windows + 1)))
    split = F.floor(n * F.lit(1 - out_of_sample))
    rows = [("full", F.lit(0), n), ("is", F.lit(0), split), ("oos", split, n)]
    rows += [r for k in range(1, windows + 1) for r in ((f"train_{k}", F.lit(0) if anchored else cut(k - 1), cut(k)), (f"test_{k}", cut(k), cut(k + 1) if k < windows else n))]
    of = F.array(*(F.struct(F.lit(name).alias("fold"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")) for name, lo, hi in rows))
    out = bars.groupBy("symbol").agg(F.count("*").alias("n")).select("symbol", F.inline(of))
    return out.withColumn("n_bars", F.col("hi") - F.col("lo")).where("n_bars >= 2")


def select_variant(scored: DataFrame, least: int, *keys: str) -> DataFrame:
    """The variant with the greatest t among those with ``least`` trades, the first of equal ones, the first of all where none has enough."""
    t = F.when(F.col("n") >= least, F.when((F.col("sd") == 0) & (F.col("mean") > 0), float("inf")).otherwise(F.coalesce("t", F.lit(0.0))))
    # Variants with the same trades tie, in whatever order their returns were summed.
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.coalesce(F.round(t, 9), F.lit(float("-inf"))).desc(), "idx"))
    return scored.withColumns({"score": t, "_k": best}).where("_k = 1").drop("_k")


def _t(payoffs: DataFrame) -> DataFrame:
    return payoffs.withColumn("t", F.col("mean") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0)))


def walk_forward(trades: DataFrame, pairs: DataFrame, windows: int = 5, least: int = 5) -> DataFrame:
    """symbol, rule, k, selected, is_ev, oos_ev, oos_trades: the best variant of each training fold, traded on the next.

    trades: symbol, variant, fold, net_return; pairs: symbol, rule, variant, idx, the whole grid.
    """
    kind, k = F.split("fold", "_")[0], F.split("fold", "_")[1].cast("int")
    own = trades.withColumns({"kind": kind, "k": k})
    train = _t(stats.payoffs(own.where("kind = 'train'"), "symbol", "variant", "k"))
    grid = pairs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(windows))))
    chosen = select_variant(grid.join(train, ["symbol", "variant", "k"], "left"), least, "symbol", "rule", "k")
    test = stats.payoffs(own.where("kind = 'test'"), "symbol", "variant", "k").select("symbol", "variant", "k", F.col("n").alias("oos_trades"), F.col("mean").alias("oos_ev"))
    rows = chosen.select("symbol", "rule", "k", "variant", F.when(F.col("score").isNotNull(), F.col("mean")).otherwise(0.0).alias("is_ev")).join(test, ["symbol", "variant", "k"], "left")
    return rows.select("symbol", "rule", "k", F.col("variant").alias("selected"), "is_ev", F.coalesce("oos_ev", F.lit(0.0)).alias("oos_ev"), F.coalesce("oos_trades", F.lit(0)).alias("oos_trades"))


def efficiency(windows: DataFrame, *keys: str) -> DataFrame:
    """Mean out-of-sample over mean in-sample value of the chosen variants; 0 without an in-sample edge. ``oos_mean`` is by trade."""
    g = windows.groupBy(*keys).agg(F.avg("is_ev").alias("_is"), F.avg("oos_ev").alias("_oos"), F.sum("oos_trades").alias("wf_trades"), F.sum(F.col("oos_ev") * F.col("oos_trades")).alias("_sum"))
    ratio = F.when(F.col("_is") > 0, F.col("_oos") / F.nullif("_is", F.lit(0.0))).otherwise(0.0)
    return g.select(*keys, ratio.alias("efficiency"), "wf_trades", F.try_divide("_sum", "wf_trades").alias("wf_mean"))


def global_discovery(tests: DataFrame, q: float = 0.05, *groups: str) -> DataFrame:
    """False-discovery control over every variant of every pair at once, or of each group: a two-level pass.

    Equal p-values are counted first, so what is ranked in order is a row for each distinct p, and no task sees all tests of a group. The ranges are written once, so that a lost
    executor cannot draw them anew.
    """
    keys = list(groups)
    counts = tests.groupBy(*keys, "p").agg(F.count("*").alias("m"))
    placed = settled(counts.repartitionByRange(*keys, "p").withColumn("_part", F.spark_partition_id()), "ranges")
    parts = placed.groupBy(*keys, "_part").agg(F.sum("m").alias("_n"), F.min("p").alias("_low"))
    # A row a group and partition: the only ordered pass over everything.
    starts = parts.select(*keys, "_part", (F.sum("_n").over(W.partitionBy(*keys).orderBy("_low")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy(*keys)).alias("_all"))
    own = W.partitionBy(*keys, "_part")
    ranked = placed.join(starts, [*keys, "_part"]).withColumn("_raw", F.col("p") * F.col("_all") / (F.col("_before") + F.sum("m").over(own.orderBy("p"))))
    lows = ranked.groupBy(*keys, "_part").agg(F.min("_raw").alias("_least"), F.min("p").alias("_low"))
    after = lows.select(*keys, "_part", F.min("_least").over(W.partitionBy(*keys).orderBy(F.desc("_low")).rowsBetween(W.unboundedPreceding, -1)).alias("_later"))
    inside = F.min("_raw").over(own.orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0))
    adjusted = ranked.join(after, [*keys, "_part"]).select(*keys, "p", F.least(F.lit(1.0), inside, F.coalesce("_later", F.lit(1.0))).alias("p_global"))
    return tests.join(adjusted, [*keys, "p"]).withColumn("global_rejected", F.col("p_global") <= q)


def sweep(trades: DataFrame, pairs: DataFrame, q: float = 0.05) -> DataFrame:
    """Every variant's in-sample test, also of variants without trades (p is 1), adjusted inside its pair."""
    own = stats.payoffs(trades.where("fold = 'is'"), "symbol", "variant")
    rows = pairs.join(own, ["symbol", "variant"], "left").fillna(0, ["n", "wins"]).fillna(0.0, ["avg_win", "avg_loss"])
    return benjamini_hochberg(stats.mean_test(rows), "p", q, "symbol", "rule")


def research_pairs(trades: DataFrame, pairs: DataFrame, current_regime: DataFrame, q: float = 0.05, min_trades: int = 30, sims: int = 5000, worst: float = -0.2, windows: int = 5) -> DataFrame:
    """A verdict for each (symbol, rule), with what it rests on.

    trades: symbol, rule, variant, fold, entry_ts, exit_ts, gross_return, net_return, regime. ``tests`` of all pairs are adjusted together for the final decision.
    """
    pair = ["symbol", "rule"]
    swept = global_discovery(sweep(trades, pairs, q), q)
    best = select_variant(swept, max(5, min_trades // 3), *pair).select(*pair, F.col("variant").alias("selected"), F.col("p").alias("is_p"), "p_adjusted", F.col("rejected").alias("survives_fdr"), "p_global", "global_rejected")
    stable = research.stability(swept.select(*pair, F.coalesce("mean", F.lit(0.0)).alias("ev")), *pair).select(*pair, "n_variants", "fraction_positive")
    chosen = trades.join(best.select(*pair, F.col("selected").alias("variant")), [*pair, "variant"])
    oos = stats.posterior(stats.mean_test(best.select(*pair).join(stats.payoffs(chosen.where("fold = 'oos'"), *pair), pair, "left").fillna(0, ["n", "wins"]).fillna(0.0, ["avg_win", "avg_loss"])))
    costs = research.cost_analysis(chosen.where("fold = 'full'"), *pair).select(*pair, "gross_ev", "net_ev")
    wf = walk_forward(trades, pairs, windows)
    eff = efficiency(wf, *pair)
    moved = trades.join(wf.select(*pair, F.col("selected").alias("variant"), F.concat(F.lit("test_"), "k").alias("fold")), [*pair, "variant", "fold"])
    drawn = moved.select(*pair, "entry_ts", "exit_ts", "net_return").unionByName(chosen.where("fold = 'oos'").join(eff.where("wf_trades = 0"), pair, "left_semi").select(*pair, "entry_ts", "exit_ts", "net_return"))
    mc = research.monte_carlo(drawn, *pair, sims=sims, loss=worst).select(*pair, "final_p50", "drawdown_p95", "p_loss")
    by_regime = stats.payoffs(chosen.where("fold = 'full'").withColumn("regime", F.coalesce("regime", F.lit("unknown"))), *pair, "regime")
    now = best.select(*pair).join(current_regime.select("symbol", F.col("regime").alias("_now")), "symbol", "left")
    compat = now.join(by_regime.select(*pair, F.col("regime").alias("_now"), F.col("n").alias("_n"), F.col("mean").alias("_m")), [*pair, "_now"], "left")
    compat = compat.select(*pair, F.when(F.coalesce("_n", F.lit(0)) < 5, 0.5).when(F.col("_m") > 0, 1.0).otherwise(0.0).alias("compatibility"))
    rows = best.join(stable, pair).join(oos, pair, "left").join(costs, pair, "left").join(eff, pair, "left").join(mc, pair, "left").join(compat, pair, "left")
    score = stats.edge_score(F.col("n"), F.col("mean"), F.col("avg_loss"), F.col("p"), F.col("p_positive"), F.col("compatibility"), min_trades)
    checks = {
        "oos_positive_ev_after_costs": F.col("mean") > 0, "oos_statistically_significant": F.col("p") < 0.05, "survives_fdr_in_sample": F.col("survives_fdr"), "walk_forward_positive": F.col("wf_mean") > 0,
        "sufficient_oos_sample": F.col("n") >= min_trades, "drawdown_within_limit": F.coalesce("drawdown_p95", F.lit(0.0)) > worst, "parameter_stability": F.col("fraction_positive") >= 0.5, "edge_after_costs": F.col("net_ev") > 0,
    }
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items())))
    return rows.withColumns({"edge_score": score, "failed": failed}).select(*pair, "selected", "n_variants", "is_p", "p_adjusted", "p_global", "global_rejected", F.col("n").alias("oos_trades"), F.col("mean").alias("oos_ev"), F.col("p").alias("oos_p"), "p_win", "gross_ev", "net_ev", "efficiency", "wf_trades", "wf_mean", "drawdown_p95", "fraction_positive", "compatibility", "edge_score", "failed")


def decide(pairs: DataFrame, tradable: DataFrame) -> DataFrame:
    """The study's decision: a candidate passes all checks and the study-wide control; one on a symbol that cannot be traded is evidence only."""
    rows = pairs.join(tradable, "symbol", "left")
    sure = (F.size("failed") == 0) & F.col("global_rejected")
    return rows.withColumn("decision", F.when(sure, F.when(F.coalesce("tradable", F.lit(False)), "CHALLENGER_CANDIDATE").otherwise("EVIDENCE_ONLY")).otherwise("REJECTED"))


def too_short(bars: DataFrame, rules: DataFrame, least: int = MIN_BARS) -> DataFrame:
    """Error rows of the symbols that have too few bars to be researched: symbol, rule, decision, error."""
    n = bars.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") < least)
    return n.crossJoin(F.broadcast(rules.select("rule").distinct())).select("symbol", "rule", F.lit("ERROR").alias("decision"), F.format_string("only %d bars (< %d)", "n", F.lit(least)).alias("error"))
