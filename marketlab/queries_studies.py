"""Registered queries of the research studies: trades by fold, metrics, walk-forward, verdicts; and of regimes and trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marketlab.functions import columns
from marketlab.operators import features, panel, research, stats, study, trades
from marketlab.operators.scan import smooth
from marketlab.plans import rules
from marketlab.queries import DAY, SQL_BARS, _catalogue, _featured, full, query, shown, sql_features
from marketlab.queries_books import _forward
from marketlab.sources import views
from marketlab.sources.books import SQL_RULES, SQL_TRIPS
from marketlab.sources.store import settled

BREAKOUT = tuple(r for r in rules.DAILY if r.name == "breakout")
KEYS = ("symbol", "variant", "fold")

SQL_REGIME = SQL_BARS + f""", lr AS (SELECT *, ln(close / lag(close) OVER s) AS log_ret, CASE WHEN count(close) OVER w200 = 200 THEN avg(close) OVER w200 END AS sma FROM b WINDOW s AS (PARTITION BY symbol ORDER BY ts), w200 AS (PARTITION BY symbol ORDER BY ts ROWS 199 PRECEDING)),
  v AS (SELECT *, CASE WHEN count(log_ret) OVER w = 20 THEN stddev_samp(log_ret) OVER w END AS vol, sma / lag(sma, 20) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS slope, close / sma - 1 AS away FROM lr WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
  se AS (SELECT *, list(vol) FILTER (vol IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS 251 PRECEDING) AS seen FROM v),
  ra AS (SELECT *, CASE WHEN vol IS NOT NULL AND len(seen) >= 60 THEN (len(list_filter(seen, lambda x: x < vol)) + (len(list_filter(seen, lambda x: x = vol)) + 1) / CAST(2 AS DOUBLE)) / len(seen) END AS k FROM se),
  rg AS (SELECT symbol, ts, CASE WHEN slope IS NULL THEN NULL WHEN away > 0.02 AND slope > 0 THEN 'bull' WHEN away < -0.02 AND slope < 0 THEN 'bear' ELSE 'sideways' END AS trend, CASE WHEN k < CAST(1 AS DOUBLE) / 3 THEN 'low_vol' WHEN k < CAST(2 AS DOUBLE) / 3 THEN 'medium_vol' WHEN k IS NOT NULL THEN 'high_vol' END AS vol_regime FROM ra)"""


@query(f"WITH {SQL_REGIME} SELECT symbol, {DAY}, trend, vol_regime, CASE WHEN trend IS NOT NULL AND vol_regime IS NOT NULL THEN trend || '/' || vol_regime ELSE '' END AS regime FROM rg")
def wn20_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_regimes(spark, sf_dir), "trend", "vol_regime", "regime")


def _regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.regime(features.averages(features.volatility(features.returns(views.bars_1d(spark, sf_dir))), (200,)))


@query(f"""WITH {SQL_BARS}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) AS DOUBLE) AS i, ln(close) AS y FROM b),
  g AS (SELECT symbol, ts, count(y) OVER w AS n, regr_sxx(y, i) OVER w AS sxx, regr_sxy(y, i) OVER w AS sxy, regr_syy(y, i) OVER w AS syy FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING)), e AS (SELECT *, sqrt(greatest(syy - sxy * sxy / sxx, 0) / 48 / sxx) AS error FROM g WHERE n = 50)
  SELECT b.symbol, CAST(CAST(b.ts AS DATE) AS VARCHAR) AS day, round(CASE WHEN error > 0 THEN sxy / sxx / error WHEN error = 0 THEN 0 END, 5) AS trend_strength FROM b LEFT JOIN e ON e.symbol = b.symbol AND e.ts = b.ts""")
def wn15_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(features.trend_strength(views.bars_1d(spark, sf_dir)), "trend_strength", digits=5)


@query(f"""WITH RECURSIVE {SQL_BARS}, n AS (SELECT symbol, ts, close, row_number() OVER s AS i, close - lag(close) OVER s AS d FROM b WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
  e AS (SELECT symbol, ts, i, close AS f, close AS s, CAST(NULL AS DOUBLE) AS sg, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l FROM n WHERE i = 1 UNION ALL
    SELECT n.symbol, n.ts, n.i, e.f * (11.0 / 13) + n.close * (2.0 / 13), e.s * (25.0 / 27) + n.close * (2.0 / 27),
      CASE WHEN n.i >= 26 THEN coalesce(e.sg * CAST(0.8 AS DOUBLE) + CAST(0.2 AS DOUBLE) * (e.f * (11.0 / 13) + n.close * (2.0 / 13) - e.s * (25.0 / 27) - n.close * (2.0 / 27)), e.f * (11.0 / 13) + n.close * (2.0 / 13) - e.s * (25.0 / 27) - n.close * (2.0 / 27)) END,
      coalesce((e.g + greatest(n.d, 0)) / 2, greatest(n.d, 0)), coalesce((e.l + greatest(-n.d, 0)) / 2, greatest(-n.d, 0)) FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)
  SELECT symbol, {DAY}, round(CASE WHEN i >= 26 THEN f - s END, 5) AS macd, round(CASE WHEN i >= 34 THEN sg END, 5) AS macd_signal, round(CASE WHEN i >= 34 THEN f - s - sg END, 5) AS macd_hist, round(CASE WHEN i >= 3 THEN CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 ELSE 50 END END, 5) AS rsi_2 FROM e""")
def wn8_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MACD with its signal, which starts at the first line, and the two-bar RSI (WN-7)."""
    return shown(features.smoothed(views.bars_1d(spark, sf_dir)), "macd", "macd_signal", "macd_hist", "rsi_2", digits=5)


SHAPE = "abs(close - open) AS body, high - greatest(open, close) AS up, least(open, close) - low AS down, nullif(high - low, 0) AS span, lag(open) OVER (PARTITION BY symbol ORDER BY ts) AS po, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc"


@query(f"""WITH {SQL_BARS}, h AS (SELECT *, {SHAPE} FROM b), k AS (SELECT *, CASE WHEN body > 0 THEN CAST(0.3 AS DOUBLE) * body ELSE CAST(0.3 AS DOUBLE) * (span * CAST(0.1 AS DOUBLE)) END AS short FROM h)
  SELECT symbol, {DAY}, CAST(coalesce(pc < po AND close > open AND open <= pc AND close >= po, false) AS INTEGER) AS pat_bullish_engulfing, CAST(coalesce(pc > po AND close < open AND open >= pc AND close <= po, false) AS INTEGER) AS pat_bearish_engulfing,
    CAST(coalesce(down >= 2 * body AND up <= short AND body / span > 0.05, false) AS INTEGER) AS pat_hammer, CAST(coalesce(up >= 2 * body AND down <= short AND body / span > 0.05, false) AS INTEGER) AS pat_shooting_star, CAST(coalesce(body / span < CAST(0.1 AS DOUBLE), false) AS INTEGER) AS pat_doji FROM k""")
def sc2_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(features.candles(views.bars_1d(spark, sf_dir)), "pat_bullish_engulfing", "pat_bearish_engulfing", "pat_hammer", "pat_shooting_star", "pat_doji")


# Trades of the breakout rule's grid in every fold, and the same by a walk over candidates in SQL.

EFFECTIVE_BUY, EFFECTIVE_SELL = "* (1 + CAST(0.00025 AS DOUBLE) + CAST(0.0005 AS DOUBLE)) * CAST(1.001 AS DOUBLE)", "* (1 - CAST(0.00025 AS DOUBLE) - CAST(0.0005 AS DOUBLE)) * CAST(0.999 AS DOUBLE)"
SQL_GRID = "g(idx, variant, vol_th, stop_atr) AS (VALUES " + ", ".join(f"({i}, '{name}', CAST({p['vol_th']} AS DOUBLE), CAST({p['stop_atr']} AS DOUBLE))" for i, (_, name, p) in enumerate(BREAKOUT[0].variants())) + ")"
SQL_FOLDS = "SELECT symbol, 'full' AS fold, 0 AS lo, last_i AS hi FROM z UNION ALL SELECT symbol, 'is', 0, CAST(floor(last_i * CAST(0.7 AS DOUBLE)) AS BIGINT) FROM z UNION ALL SELECT symbol, 'oos', CAST(floor(last_i * CAST(0.7 AS DOUBLE)) AS BIGINT), last_i FROM z" + "".join(
    f" UNION ALL SELECT symbol, 'train_{k}', 0, CAST(floor({k} * (last_i / CAST(6 AS DOUBLE))) AS BIGINT) FROM z UNION ALL SELECT symbol, 'test_{k}', CAST(floor({k} * (last_i / CAST(6 AS DOUBLE))) AS BIGINT), {f'CAST(floor({k + 1} * (last_i / CAST(6 AS DOUBLE))) AS BIGINT)' if k < 5 else 'last_i'} FROM z" for k in range(1, 6)
)
SQL_STUDY = f"""{SQL_BARS}, {SQL_GRID}, n AS MATERIALIZED (SELECT *, row_number() OVER s AS i, count(*) OVER (PARTITION BY symbol) AS last_i, greatest(high - low, coalesce(abs(high - lag(close) OVER s), 0), coalesce(abs(low - lag(close) OVER s), 0)) AS tr,
    CASE WHEN count(high) OVER w = 20 THEN max(high) OVER w END AS h20, CASE WHEN count(volume) OVER p = 20 THEN volume / nullif(avg(volume) OVER p, 0) END AS vr, lead(open) OVER s AS next_open, lead(ts) OVER s AS next_ts, lag(close) OVER s AS before
    FROM b WINDOW s AS (PARTITION BY symbol ORDER BY ts), w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
  av AS (SELECT symbol, i, tr AS a FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.i, av.a * (13.0 / 14) + n.tr / 14.0 FROM av JOIN n ON n.symbol = av.symbol AND n.i = av.i + 1),
  x AS MATERIALIZED (SELECT n.*, av.a, lag(h20) OVER (PARTITION BY n.symbol ORDER BY ts) AS prev FROM n JOIN av ON av.symbol = n.symbol AND av.i = n.i),
  c AS MATERIALIZED (SELECT symbol, idx, variant, last_i, i + 1 AS entry_i, next_ts AS entry_ts, next_open AS entry_price, next_open - stop_atr * a AS stop, next_open + 3 * a AS target FROM x CROSS JOIN g WHERE close > prev AND vr > vol_th AND i >= 14 AND next_open IS NOT NULL),
  hp AS (SELECT c.*, n.i, n.ts AS bar_ts, CASE WHEN n.i > entry_i AND n.i - entry_i >= 15 THEN row('max_holding', n.open) WHEN n.low <= stop THEN row('stop', CASE WHEN n.i = entry_i THEN stop ELSE least(n.open, stop) END)
    WHEN n.high >= target THEN row('target', CASE WHEN n.i = entry_i THEN target ELSE greatest(n.open, target) END) WHEN n.i = c.last_i THEN row('end_of_data', n.close) END AS ended FROM c JOIN n ON n.symbol = c.symbol AND n.i BETWEEN entry_i AND entry_i + 15),
  ex AS MATERIALIZED (SELECT symbol, idx, variant, entry_i, entry_ts, entry_price, min(i) AS exit_i, arg_min(ended, i) AS ended, arg_min(bar_ts, i) AS exit_ts FROM hp WHERE ended IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6),
  z AS (SELECT symbol, count(*) AS last_i FROM b GROUP BY 1), fo AS MATERIALIZED ({SQL_FOLDS}),
  sf AS MATERIALIZED (SELECT ex.symbol, idx, variant, fold, lo, hi, entry_i, entry_ts, entry_price, least(exit_i, hi) AS exit_i, CASE WHEN exit_i <= hi THEN ended[1] ELSE 'end_of_data' END AS reason, CASE WHEN exit_i <= hi THEN ended[2] ELSE n.close END AS exit_price, CASE WHEN exit_i <= hi THEN exit_ts ELSE n.ts END AS exit_ts
    FROM ex JOIN fo ON fo.symbol = ex.symbol JOIN n ON n.symbol = fo.symbol AND n.i = hi WHERE entry_i - 2 >= lo AND entry_i <= hi),
  nx AS MATERIALIZED (SELECT l.symbol, l.idx, l.fold, l.entry_i, r.entry_i AS then_i FROM sf AS l ASOF LEFT JOIN sf AS r ON l.symbol = r.symbol AND l.idx = r.idx AND l.fold = r.fold AND l.exit_i < r.entry_i),
  wk AS (SELECT symbol, idx, fold, min(entry_i) AS entry_i FROM sf GROUP BY 1, 2, 3 UNION ALL SELECT nx.symbol, nx.idx, nx.fold, nx.then_i FROM wk JOIN nx ON nx.symbol = wk.symbol AND nx.idx = wk.idx AND nx.fold = wk.fold AND nx.entry_i = wk.entry_i WHERE nx.then_i IS NOT NULL),
  td AS MATERIALIZED (SELECT sf.*, exit_price / entry_price - 1 AS gross_return, (exit_price {EFFECTIVE_SELL}) / (entry_price {EFFECTIVE_BUY}) - 1 AS net_return FROM sf JOIN wk USING (symbol, idx, fold, entry_i))"""


def _breakout(spark: SparkSession, sf_dir: str, bounds=study.fold_bounds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, folds and net trades of the breakout grid in every fold."""
    b = features.volume_ratio(features.extremes(smooth(features.true_range(views.bars_1d(spark, sf_dir)), {"atr": ("true_range", 1 / 14, 14)})))
    b = settled(b, "bars")
    enter, leave = rules.conditions(BREAKOUT)
    found = trades.candidates(b, rules.variant_table(spark, BREAKOUT), enter, leave)
    folds = bounds(b)
    kept = trades.net_returns(trades.single_position(trades.in_folds(found, folds, b)))
    return b, folds, settled(kept.withColumn("rule", F.lit("breakout")), "trades")


def _grid(spark: SparkSession, b: DataFrame, chosen: tuple[rules.Rule, ...]) -> DataFrame:
    """symbol, rule, variant, idx: the whole grid, a row a hypothesis."""
    rows = [(r.name, name, i) for r in chosen for i, (_, name, _) in enumerate(r.variants())]
    return b.select("symbol").distinct().crossJoin(F.broadcast(spark.createDataFrame(rows, "rule string, variant string, idx int")))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*(F.round(n, digits).alias(n) if kinds[n] == "double" else F.col(n) for n in names))


@query(f"WITH RECURSIVE {SQL_STUDY} SELECT symbol, variant, fold, strftime(entry_ts, '%Y-%m-%d') AS entry_day, strftime(exit_ts, '%Y-%m-%d') AS exit_day, reason, round(gross_return, 6) AS gross_return, round(net_return, 6) AS net_return FROM td")
def ex1_breakout_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of nine variants in the whole series and in every fold (EX-1, EX-4)."""
    t = _breakout(spark, sf_dir)[2]
    return rounded(t.withColumns({"entry_day": F.date_format("entry_ts", "yyyy-MM-dd"), "exit_day": F.date_format("exit_ts", "yyyy-MM-dd")}), "symbol", "variant", "fold", "entry_day", "exit_day", "reason", "gross_return", "net_return")


SQL_SERIES = f"""hb AS (SELECT td.symbol, td.variant, td.fold, hi - lo AS n_bars, n.i, CASE WHEN n.i = exit_i THEN exit_price {EFFECTIVE_SELL} ELSE n.close END / CASE WHEN n.i = entry_i THEN entry_price {EFFECTIVE_BUY} ELSE n.before END - 1 AS r, CASE WHEN n.i = exit_i AND reason = 'max_holding' THEN 0 ELSE 1 END AS x FROM td JOIN n ON n.symbol = td.symbol AND n.i BETWEEN entry_i AND exit_i),
  eq AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol, variant, fold ORDER BY i)) AS eq FROM hb), dd AS (SELECT *, eq / greatest(1, max(eq) OVER (PARTITION BY symbol, variant, fold ORDER BY i)) - 1 AS dd FROM eq),
  sm AS (SELECT symbol, variant, fold, n_bars, arg_max(eq, i) - 1 AS total_return, least(0, min(dd)) AS max_drawdown, sum(r) / n_bars AS m, sum(r * r) AS q, sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) AS d, sum(x) / CAST(n_bars AS DOUBLE) AS exposure FROM dd GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH RECURSIVE {SQL_STUDY}, {SQL_SERIES}, tm AS (SELECT symbol, variant, fold, count(*) AS n, avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0 END) AS win_rate, coalesce(avg(net_return) FILTER (net_return > 0), 0) AS avg_win, coalesce(avg(-net_return) FILTER (net_return <= 0), 0) AS avg_loss, avg(net_return) AS ev FROM td GROUP BY 1, 2, 3)
  SELECT symbol, variant, fold, n, round(win_rate, 6) AS win_rate, round(avg_win, 6) AS avg_win, round(avg_loss, 6) AS avg_loss, round(ev, 6) AS ev, round(ln(1 + total_return), 6) AS log_growth, round(max_drawdown, 6) AS max_drawdown, round(m / sqrt((q - n_bars * m * m) / (n_bars - 1)) * sqrt(252), 5) AS sharpe,
    round(CASE WHEN d > 0 THEN m / sqrt(d / n_bars) * sqrt(252) ELSE 0 END, 5) AS sortino, round(exposure, 6) AS exposure FROM tm JOIN sm USING (symbol, variant, fold)""")
def ag3_breakout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade metrics with drawdown, Sharpe, Sortino and exposure of the bars (AG-3, EX-3, WN-16, SC-10)."""
    b, folds, t = _breakout(spark, sf_dir)
    series = trades.bar_series(t, b).join(folds.select("symbol", "fold", "n_bars"), ["symbol", "fold"])
    bars_ = trades.series_metrics(series, study.PERIODS_PER_YEAR["1d"], *KEYS)
    m = trades.metrics(t, *KEYS).drop("total_return", "sharpe", "sortino").join(bars_, list(KEYS)).withColumns({c: F.round(c, 5) for c in ("sharpe", "sortino")}).withColumn("log_growth", F.log1p("total_return"))
    return rounded(m, *KEYS, "n", "win_rate", "avg_win", "avg_loss", "ev", "log_growth", "max_drawdown", "sharpe", "sortino", "exposure")


@query(f"WITH RECURSIVE {SQL_STUDY} SELECT variant, strftime(entry_ts, '%Y-%m-%d') AS entry_day, round(avg(net_return), 6) AS net_return, count(*) AS n FROM td WHERE fold = 'full' GROUP BY 1, 2")
def ag4_breakout_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation for each entry date of a variant over all symbols (AG-4, EX-5)."""
    d = research.date_means(_breakout(spark, sf_dir)[2].where("fold = 'full'"), "variant")
    return rounded(d.withColumn("entry_day", F.date_format("entry_ts", "yyyy-MM-dd")), "variant", "entry_day", "net_return", "n")


@query(f"WITH RECURSIVE {SQL_STUDY}, {SQL_REGIME.split(SQL_BARS + ', ')[1]}, tr2 AS (SELECT td.*, CASE WHEN trend IS NOT NULL AND vol_regime IS NOT NULL THEN trend || '/' || vol_regime ELSE 'unknown' END AS regime FROM td JOIN n ON n.symbol = td.symbol AND n.i = td.entry_i - 1 JOIN rg ON rg.symbol = n.symbol AND rg.ts = n.ts WHERE fold = 'full') SELECT symbol, variant, regime, count(*) AS n, round(avg(net_return), 6) AS ev FROM tr2 GROUP BY 1, 2, 3")
def ag5_breakout_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by the regime of the signal's bar (AG-5, EX-6)."""
    t = _breakout(spark, sf_dir)[2].where("fold = 'full'")
    m = trades.metrics(study_regimes(t, _regimes(spark, sf_dir)), "symbol", "variant", "regime")
    return rounded(m, "symbol", "variant", "regime", "n", "ev")


def study_regimes(t: DataFrame, regimes: DataFrame) -> DataFrame:
    """Trades with the regime of the bar before their entry; unknown where it has none."""
    own = regimes.select("symbol", (F.row_number().over(W.partitionBy("symbol").orderBy("ts")) + 1).alias("entry_i"), F.coalesce(F.nullif("regime", F.lit("")), F.lit("unknown")).alias("regime"))
    return t.join(own, ["symbol", "entry_i"], "left")


@query(f"WITH RECURSIVE {SQL_STUDY} SELECT symbol, variant, round(avg(gross_return), 6) AS gross_ev, round(avg(net_return), 6) AS net_ev, round(avg(gross_return - net_return), 6) AS mean_cost FROM td WHERE fold = 'full' GROUP BY 1, 2")
def ag6_breakout_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(research.cost_analysis(_breakout(spark, sf_dir)[2].where("fold = 'full'"), "symbol", "variant"), "symbol", "variant", "gross_ev", "net_ev", "mean_cost")


@query(f"""WITH RECURSIVE {SQL_STUDY}, ev AS (SELECT z.symbol, g.variant, coalesce(avg(net_return), 0) AS ev FROM z CROSS JOIN g LEFT JOIN td ON td.symbol = z.symbol AND td.variant = g.variant AND fold = 'is' GROUP BY 1, 2), s AS (SELECT symbol, count(*) AS n_variants, avg(CASE WHEN ev > 0 THEN 1.0 ELSE 0 END) AS f, median(ev) AS m, max(ev) AS b FROM ev GROUP BY 1)
  SELECT symbol, n_variants, round(f, 6) AS fraction_positive, round(m, 6) AS median_ev, round(b, 6) AS best_ev, round(f * CASE WHEN m > 0 AND b > 0 THEN m / b ELSE 0 END, 6) AS score FROM s""")
def ag7_breakout_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, _, t = _breakout(spark, sf_dir)
    swept = study.sweep(t, _grid(spark, b, BREAKOUT))
    return rounded(research.stability(swept.select("symbol", F.coalesce("mean", F.lit(0.0)).alias("ev")), "symbol"), "symbol", "n_variants", "fraction_positive", "median_ev", "best_ev", "score")


SQL_WALK = """pf AS (SELECT symbol, idx, fold, count(*) AS n, avg(net_return) AS mean, avg(net_return) / (stddev_samp(net_return) / sqrt(count(*))) AS t FROM td GROUP BY 1, 2, 3),
  tn AS (SELECT z.symbol, k, g.idx, g.variant, mean, CASE WHEN n >= 5 THEN t END AS score FROM z CROSS JOIN g CROSS JOIN range(1, 6) AS r(k) LEFT JOIN pf ON pf.symbol = z.symbol AND pf.idx = g.idx AND fold = 'train_' || k),
  bt AS (SELECT *, row_number() OVER (PARTITION BY symbol, k ORDER BY round(score, 9) DESC NULLS LAST, idx) AS place FROM tn),
  wf AS (SELECT bt.symbol, CAST(k AS INTEGER) AS k, variant AS selected, CASE WHEN score IS NULL THEN 0 ELSE bt.mean END AS is_ev, coalesce(pf.mean, 0) AS oos_ev, coalesce(pf.n, 0) AS oos_trades FROM bt LEFT JOIN pf ON pf.symbol = bt.symbol AND pf.idx = bt.idx AND fold = 'test_' || k WHERE place = 1)"""


@query(f"WITH RECURSIVE {SQL_STUDY}, {SQL_WALK} SELECT symbol, k, selected, round(is_ev, 6) AS is_ev, round(oos_ev, 6) AS oos_ev, oos_trades FROM wf")
def rs3_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, _, t = _breakout(spark, sf_dir)
    return rounded(study.walk_forward(t, _grid(spark, b, BREAKOUT)), "symbol", "k", "selected", "is_ev", "oos_ev", "oos_trades")


@query(f"WITH RECURSIVE {SQL_STUDY}, {SQL_WALK} SELECT symbol, round(CASE WHEN avg(is_ev) > 0 THEN avg(oos_ev) / avg(is_ev) ELSE 0 END, 6) AS efficiency, CAST(sum(oos_trades) AS BIGINT) AS wf_trades, round(sum(oos_ev * oos_trades) / nullif(sum(oos_trades), 0), 6) AS wf_mean FROM wf GROUP BY 1")
def rs4_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, _, t = _breakout(spark, sf_dir)
    return rounded(study.efficiency(study.walk_forward(t, _grid(spark, b, BREAKOUT)), "symbol"), "symbol", "efficiency", "wf_trades", "wf_mean")


def _study(spark: SparkSession, sf_dir: str, chosen: tuple[rules.Rule, ...]) -> DataFrame:
    b = settled(_featured(spark, sf_dir), "bars")
    ok = b.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") >= study.MIN_BARS).select("symbol")
    long_ = b.join(ok, "symbol", "left_semi")
    enter, leave = rules.conditions(chosen)
    found = settled(trades.candidates(long_, rules.variant_table(spark, chosen), enter, leave), "candidates")
    kept = trades.net_returns(trades.single_position(trades.in_folds(found, study.fold_bounds(long_), long_)))
    t = settled(study_regimes(kept.withColumn("rule", F.regexp_extract("variant", r"^[^\[]+", 0)), long_), "trades")
    grid = _grid(spark, long_, chosen)
    current = long_.where("regime <> ''").groupBy("symbol").agg(F.max_by("regime", "ts").alias("regime"))
    tradable = b.select("symbol").distinct().withColumn("tradable", F.col("symbol") != "NO")
    out = study.decide(study.research_pairs(t, grid, current), tradable)
    return out.unionByName(study.too_short(b, grid.select("rule")), allowMissingColumns=True)


@query()
def rs9_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol with every daily rule: choice, frozen test, walk-forward, resampling, study-wide control, checks and decision (RS-6, RS-8, RS-9)."""
    return _study(spark, sf_dir, rules.DAILY)


# Verdicts in SQL, with tails in closed form: Student's for whole degrees of freedom, Beta's for whole parameters. Resampling has no SQL.


def _student_sql(t: str, df: str) -> str:
    """One-sided p of t, as a finite sum of powers of the angle's cosine."""
    c2 = f"(CAST({df} AS DOUBLE) / ({df} + ({t}) * ({t})))"
    even = f"sqrt(1 - {c2}) * sign({t}) * list_sum(list_transform(range(0, CAST({df} // 2 AS BIGINT)), lambda j: exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - j * ln(4) + j * ln({c2}))))"
    odd = f"2 / pi() * (atan(({t}) / sqrt({df})) + coalesce(sqrt(1 - {c2}) * sign({t}) * sqrt({c2}) * list_sum(list_transform(range(0, CAST(({df} - 1) // 2 AS BIGINT)), lambda j: exp(j * ln(4) + 2 * lgamma(j + 1) - lgamma(2 * j + 2) + j * ln({c2})))), 0))"
    return f"(1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END) / 2"


def _p_sql(n: str = "n", mean: str = "mean", sd: str = "sd") -> str:
    return f"CASE WHEN {n} < 2 THEN 1 WHEN {sd} = 0 THEN CASE WHEN {mean} > 0 THEN 0 ELSE 1 END ELSE {_student_sql(f'{mean} / ({sd} / sqrt({n}))', f'({n} - 1)')} END"


#: P(Beta(1 + wins, 1 + n - wins) > x), a sum of binomial terms.
BETA_SQL = "CASE WHEN x <= 0 THEN 1 WHEN x >= 1 THEN 0 ELSE list_sum(list_transform(range(0, CAST(wins + 1 AS BIGINT)), lambda j: exp(lgamma(n + 2) - lgamma(j + 1) - lgamma(n + 2 - j) + j * ln(x) + (n + 1 - j) * ln(1 - x)))) END"


def _verdict_sql(trades_: str, symbols: str) -> str:
    """CTEs from trades (symbol, idx, fold, gross_return, net_return) and the grid g to vd, a row a symbol."""
    return f"""py AS MATERIALIZED (SELECT symbol, idx, fold, count(*) AS n, count(*) FILTER (net_return > 0) AS wins, avg(net_return) AS mean, stddev_samp(net_return) AS sd, coalesce(avg(net_return) FILTER (net_return > 0), 0) AS avg_win, coalesce(avg(-net_return) FILTER (net_return <= 0), 0) AS avg_loss, avg(gross_return) AS gross FROM {trades_} GROUP BY 1, 2, 3),
  hy AS (SELECT s.symbol, g.idx, g.variant FROM ({symbols}) AS s CROSS JOIN g),
  sw AS MATERIALIZED (SELECT *, {_p_sql()} AS p, CASE WHEN n >= 10 THEN CASE WHEN sd = 0 AND mean > 0 THEN 'inf'::DOUBLE ELSE coalesce(mean / nullif(sd / sqrt(n), 0), 0) END END AS score FROM (SELECT hy.*, coalesce(n, 0) AS n, mean, sd FROM hy LEFT JOIN py ON py.symbol = hy.symbol AND py.idx = hy.idx AND fold = 'is')),
  rw AS (SELECT *, p * count(*) OVER (PARTITION BY symbol) / count(*) OVER (PARTITION BY symbol ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r1, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r2 FROM sw),
  aj AS (SELECT *, least(1, min(r1) OVER (PARTITION BY symbol ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adjusted, least(1, min(r2) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_global FROM rw),
  bs AS (SELECT * FROM aj QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(score, 9) DESC NULLS LAST, idx) = 1),
  sb AS (SELECT symbol, count(*) AS n_variants, avg(CASE WHEN mean > 0 THEN 1.0 ELSE 0 END) AS fraction_positive FROM sw GROUP BY 1),
  tq AS (SELECT hy.symbol, k, hy.idx, hy.variant, mean, CASE WHEN n >= 5 THEN CASE WHEN sd = 0 AND mean > 0 THEN 'inf'::DOUBLE ELSE coalesce(mean / nullif(sd / sqrt(n), 0), 0) END END AS score FROM hy CROSS JOIN range(1, 6) AS r(k) LEFT JOIN py ON py.symbol = hy.symbol AND py.idx = hy.idx AND fold = 'train_' || k),
  bq AS (SELECT * FROM tq QUALIFY row_number() OVER (PARTITION BY symbol, k ORDER BY round(score, 9) DESC NULLS LAST, idx) = 1),
  wq AS (SELECT bq.symbol, avg(CASE WHEN score IS NULL THEN 0 ELSE bq.mean END) AS is_ev, avg(coalesce(py.mean, 0)) AS oos_ev, sum(coalesce(py.n, 0)) AS wf_trades, sum(py.mean * py.n) / nullif(sum(py.n), 0) AS wf_mean FROM bq LEFT JOIN py ON py.symbol = bq.symbol AND py.idx = bq.idx AND fold = 'test_' || k GROUP BY 1),
  oq AS (SELECT b.symbol, coalesce(p.n, 0) AS n, coalesce(wins, 0) AS wins, p.mean, p.sd, coalesce(avg_win, 0) AS avg_win, coalesce(avg_loss, 0) AS avg_loss FROM bs AS b LEFT JOIN py AS p ON p.symbol = b.symbol AND p.idx = b.idx AND fold = 'oos'),
  oo AS (SELECT *, {_p_sql()} AS p, {BETA_SQL} AS p_positive FROM (SELECT *, CASE WHEN avg_win + avg_loss > 0 THEN avg_loss / (avg_win + avg_loss) ELSE 1 END AS x FROM oq)),
  vj AS (SELECT b.symbol, b.variant AS selected, n_variants, b.p AS is_p, p_adjusted, p_global, o.n AS oos_trades, o.mean AS oos_ev, o.p AS oos_p, (1 + wins) / CAST(o.n + 2 AS DOUBLE) AS p_win, f.gross AS gross_ev, f.mean AS net_ev, CASE WHEN is_ev > 0 THEN w.oos_ev / is_ev ELSE 0 END AS efficiency, wf_trades, wf_mean, fraction_positive,
      CASE WHEN o.n = 0 OR coalesce(o.mean, 0) <= 0 THEN 0 ELSE 100 * (1 - o.p) * least(1, o.n / CAST(30 AS DOUBLE)) * CAST(0.5 AS DOUBLE) * CASE WHEN avg_loss > 0 THEN tanh(o.mean / (avg_loss + 1e-9)) ELSE 1 END * p_positive END AS edge_score
    FROM bs AS b JOIN sb ON sb.symbol = b.symbol JOIN (SELECT symbol, n, wins, mean, p, avg_loss, p_positive FROM oo) AS o ON o.symbol = b.symbol JOIN wq AS w ON w.symbol = b.symbol LEFT JOIN (SELECT symbol AS s, idx AS i, gross, mean FROM py WHERE fold = 'full') AS f ON f.s = b.symbol AND f.i = b.idx),
  vd AS (SELECT *, array_to_string(list_filter([CASE WHEN oos_ev > 0 THEN '' ELSE 'oos_positive_ev_after_costs' END, CASE WHEN oos_p < 0.05 THEN '' ELSE 'oos_statistically_significant' END, CASE WHEN p_adjusted <= 0.05 THEN '' ELSE 'survives_fdr_in_sample' END, CASE WHEN wf_mean > 0 THEN '' ELSE 'walk_forward_positive' END,
    CASE WHEN oos_trades >= 30 THEN '' ELSE 'sufficient_oos_sample' END, CASE WHEN fraction_positive >= 0.5 THEN '' ELSE 'parameter_stability' END, CASE WHEN net_ev > 0 THEN '' ELSE 'edge_after_costs' END], lambda c: c <> ''), ',') AS failed FROM vj)"""


VERDICT = ("symbol", "selected", "n_variants", "is_p", "p_adjusted", "p_global", "oos_trades", "oos_ev", "oos_p", "p_win", "gross_ev", "net_ev", "efficiency", "wf_trades", "wf_mean", "fraction_positive", "edge_score", "failed")
SQL_VERDICT = ", ".join(c if c in ("symbol", "selected", "n_variants", "oos_trades", "failed") else f"CAST({c} AS BIGINT) AS {c}" if c == "wf_trades" else f"round({c}, 6) AS {c}" for c in VERDICT)


def _shown_verdict(rows: DataFrame, *more: str) -> DataFrame:
    """Without the check of drawdowns, which rests on resampling."""
    return rounded(rows.withColumn("failed", F.array_join(F.array_remove("failed", "drawdown_within_limit"), ",")), *VERDICT, *more)


@query(f"WITH RECURSIVE {SQL_STUDY}, {_verdict_sql('td', 'SELECT symbol FROM z')} SELECT {SQL_VERDICT} FROM vd")
def rs8_breakout_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole research of the breakout rule on every symbol, in no known regime: choice, tests, walk-forward, stability, costs, score, failed checks."""
    b, _, t = _breakout(spark, sf_dir)
    nowhere = b.select("symbol").limit(0).withColumn("regime", F.lit(None).cast("string"))
    return _shown_verdict(study.research_pairs(t.withColumn("regime", F.lit(None).cast("string")), _grid(spark, b, BREAKOUT), nowhere))


#: Folds on the frontiers of all symbols' dates, as ranges of each symbol's rows.
SQL_PANEL_FOLDS = """SELECT f.symbol, fold, count(*) FILTER (lo_ts IS NOT NULL AND b.ts < lo_ts) AS lo, count(*) FILTER (hi_ts IS NULL OR b.ts < hi_ts) AS hi FROM (SELECT symbol, fold, lo_ts, hi_ts FROM z CROSS JOIN sp) AS f JOIN b ON b.symbol = f.symbol GROUP BY 1, 2 HAVING count(*) FILTER (hi_ts IS NULL OR b.ts < hi_ts) - count(*) FILTER (lo_ts IS NOT NULL AND b.ts < lo_ts) >= 2"""
SQL_SPANS = """us AS MATERIALIZED (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM b)), eg AS (SELECT k, (SELECT ts FROM us WHERE i = least(CAST(floor(k * (n / CAST(6 AS DOUBLE))) AS BIGINT), n - 1)) AS ts FROM range(1, 7) AS r(k)), fr AS (SELECT ts FROM us WHERE i = CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT)),
  sp AS (SELECT 'full' AS fold, NULL::TIMESTAMP AS lo_ts, NULL::TIMESTAMP AS hi_ts UNION ALL SELECT 'is', NULL, ts FROM fr UNION ALL SELECT 'oos', ts, NULL FROM fr UNION ALL SELECT 'train_' || k, NULL, ts FROM eg WHERE k < 6 UNION ALL SELECT 'test_' || a.k, a.ts, CASE WHEN a.k < 5 THEN b.ts END FROM eg AS a JOIN eg AS b ON b.k = a.k + 1)"""
SQL_PANEL = SQL_STUDY.replace(f"fo AS MATERIALIZED ({SQL_FOLDS})", f"{SQL_SPANS}, fo AS MATERIALIZED ({SQL_PANEL_FOLDS})") + ", pd AS MATERIALIZED (SELECT '*' AS symbol, idx, fold, entry_ts, avg(net_return) AS net_return, avg(gross_return) AS gross_return FROM td GROUP BY idx, fold, entry_ts)"


@query(f"WITH RECURSIVE {SQL_PANEL}, " + _verdict_sql("pd", "SELECT '*' AS symbol") + f" SELECT {SQL_VERDICT}, (SELECT count(*) FROM td WHERE fold = 'oos' AND td.variant = selected) AS n_trades_total FROM vd")
def rs10_panel_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breakout rule over all symbols at once: common dates split the folds, entry dates are the observations (RS-10)."""
    b, _, t = _breakout(spark, sf_dir, panel.fold_bounds)
    return _shown_verdict(panel.research(t, _grid(spark, b, BREAKOUT)), "n_trades_total")


@query(f"WITH RECURSIVE {SQL_PANEL} SELECT symbol, fold, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, CAST(hi - lo AS BIGINT) AS n_bars FROM fo")
def rs10_panel_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every symbol between the panel's common frontiers (JN-11)."""
    return panel.fold_bounds(views.bars_1d(spark, sf_dir))


@query(f"""WITH {SQL_TRIPS}, {SQL_RULES}, fw AS (SELECT rule, net_return FROM rt JOIN re ON rt.seq = re.seq WHERE book = 'shadow' QUALIFY row_number() OVER (PARTITION BY rule ORDER BY exit_ts DESC, rt.seq DESC) <= 500),
  g AS (SELECT rule, count(*) AS n, count(*) FILTER (net_return > 0) AS wins, avg(net_return) AS mean, stddev_samp(net_return) AS sd, coalesce(avg(net_return) FILTER (net_return > 0), 0) AS avg_win, coalesce(avg(-net_return) FILTER (net_return <= 0), 0) AS avg_loss FROM fw GROUP BY 1),
  t AS (SELECT *, {_p_sql()} AS p, {BETA_SQL} AS p_positive FROM (SELECT *, CASE WHEN avg_win + avg_loss > 0 THEN avg_loss / (avg_win + avg_loss) ELSE 1 END AS x FROM g)),
  r AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM t), a AS (SELECT *, least(1, min(raw) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adjusted FROM r)
  SELECT rule, n, round(wins / CAST(n AS DOUBLE), 6) AS win_rate, round(mean, 6) AS mean, round(p, 6) AS p, round(p_adjusted, 6) AS p_adjusted, round(CASE WHEN mean <= 0 THEN 0 ELSE 100 * (1 - p_adjusted) * least(1, n / CAST(30 AS DOUBLE)) * CASE WHEN avg_loss > 0 THEN tanh(mean / (avg_loss + 1e-9)) ELSE 1 END * p_positive END, 6) AS edge_score,
    round((1 + wins) / CAST(n + 2 AS DOUBLE), 6) AS p_win, round(CASE WHEN n >= 2 THEN mean + 0.003 END, 6) AS gross_edge, round(p_positive, 6) AS p_positive FROM a""")
def ev1_forward_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of every rule from its last 500 shadow returns, adjusted across rules."""
    return rounded(stats.evidence(_forward(spark, sf_dir), "rule"), "rule", "n", "win_rate", "mean", "p", "p_adjusted", "edge_score", "p_win", "gross_edge", "p_positive")
