"""Registered queries over books of trades: evidence, reports, gates, reviews, rankings, sets and order screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marketlab.operators import desk, joins, ledger, stats, ticks
from marketlab.queries import SQL_BARS, SQL_QUOTES, SQL_TRADES, query
from marketlab.sources import books, views
from marketlab.sources.books import SQL_EQUITY, SQL_OPS, SQL_RULES, SQL_TRIPS

PAYOFF = "count(*) AS n, CAST(count(*) FILTER (net_return > 0) AS BIGINT) AS wins, avg(net_return) AS mean, stddev_samp(net_return) AS sd, coalesce(avg(net_return) FILTER (net_return > 0), 0) AS avg_win, coalesce(avg(-net_return) FILTER (net_return <= 0), 0) AS avg_loss"


def r6(df: DataFrame, *names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def text(name: str) -> F.Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query(f"WITH {SQL_TRIPS} SELECT strategy, CAST(count(*) AS BIGINT) AS n, round(avg(net_return), 6) AS mean, round(avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate FROM rt WHERE book = 'shadow' GROUP BY 1 ORDER BY n DESC, strategy LIMIT 20")
def ag9_forward_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.payoffs(books.round_trips(spark, sf_dir).where("book = 'shadow'"), "strategy")
    return p.orderBy(F.desc("n"), "strategy").limit(20).select("strategy", "n", F.round("mean", 6).alias("mean"), F.round(F.col("wins") / F.col("n"), 6).alias("win_rate"))


@query(f"WITH {SQL_TRIPS} SELECT run_id, book, round(sum(pnl), 4) AS pnl, count(*) AS trips FROM rt GROUP BY 1, 2")
def ag13_realised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.realised(books.round_trips(spark, sf_dir), "run_id", "book").withColumn("pnl", F.round("pnl", 4))


@query(f"""WITH {SQL_TRIPS}, m AS (SELECT max(exit_ts) + INTERVAL 1 SECOND AS now FROM rt), w AS (SELECT CAST(floor((epoch_us(now) - epoch_us(exit_ts) - 1) / 604800000000.0) AS INTEGER) AS week, pnl FROM rt, m)
  SELECT week, round(sum(pnl), 4) AS pnl, count(*) AS trips FROM w WHERE week BETWEEN 0 AND 3 GROUP BY 1""")
def ag14_weekly_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = books.round_trips(spark, sf_dir)
    now = trips.agg((F.max("exit_ts") + F.expr("interval 1 second")).alias("now"))
    return ledger.weekly_pnl(trips.crossJoin(F.broadcast(now)), F.col("now")).withColumn("pnl", F.round("pnl", 4))


@query(f"""WITH {SQL_TRIPS}, l AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY exit_ts DESC, seq DESC) AS k FROM rt WHERE book = 'shadow')
  SELECT strategy, round(exp(sum(ln(1 + net_return))) - 1, 6) AS cumulative, count(*) AS n FROM l WHERE k <= 500 GROUP BY 1""")
def ag15_shadow_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.last_returns(books.round_trips(spark, sf_dir).where("book = 'shadow'"), "strategy", ("exit_ts", "seq"))
    return rows.groupBy("strategy").agg(F.round(F.product(1 + F.col("net_return")) - 1, 6).alias("cumulative"), F.count("*").alias("n"))


@query(f"""WITH {SQL_TRIPS}, l AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY exit_ts DESC, seq DESC) AS k FROM rt) SELECT strategy, seq, CAST(k AS INTEGER) AS k FROM l WHERE k <= 500""")
def wn26_last_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.last_returns(books.round_trips(spark, sf_dir), "strategy", ("exit_ts", "seq"))
    return rows.select("strategy", "seq", F.row_number().over(W.partitionBy("strategy").orderBy(F.desc("exit_ts"), F.desc("seq"))).alias("k"))


@query(f"""WITH {SQL_TRIPS}, g AS (SELECT *, sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY exit_ts, seq) AS island FROM rt)
  SELECT run_id, seq, CAST(sum(CASE WHEN pnl <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, island ORDER BY exit_ts, seq) AS BIGINT) AS consecutive_losses FROM g""")
def wn27_losing_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.losing_streaks(books.round_trips(spark, sf_dir), "run_id").select("run_id", "seq", "consecutive_losses")


SQL_FACTORS = SQL_EQUITY + ", " + SQL_OPS + """, ss AS (SELECT run_id, ts - INTERVAL 6 YEAR AS ts FROM oe WHERE kind = 'session_start'), l AS (SELECT *, lag(ts) OVER w AS pt, lag(equity) OVER w AS pe, lag(buy_hold) OVER w AS pb FROM eq WINDOW w AS (PARTITION BY run_id ORDER BY ts)),
  fa AS (SELECT run_id, ts, equity / pe AS equity_factor, buy_hold / pb AS benchmark_factor FROM l WHERE pt IS NOT NULL AND epoch_us(ts) - epoch_us(pt) <= 172800000000 AND pe > 0 AND pb <> 0 AND buy_hold <> 0 AND NOT EXISTS (SELECT 1 FROM ss WHERE ss.run_id = l.run_id AND ss.ts > l.pt AND ss.ts <= l.ts))"""


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = books.ops_events(spark, sf_dir).where("kind = 'session_start'").withColumn("ts", F.expr("ts - interval 6 years"))
    return ledger.session_factors(books.equity(spark, sf_dir), starts, 2 * 86_400)


@query(f"WITH {SQL_FACTORS} SELECT run_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(equity_factor, 6) AS equity_factor, round(benchmark_factor, 6) AS benchmark_factor FROM fa")
def wn28_session_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _factors(spark, sf_dir)
    return f.select("run_id", text("ts"), *r6(f, "equity_factor", "benchmark_factor"))


@query(f"""WITH {SQL_OPS}, b AS (SELECT *, kind IN ('reconciliation_mismatch', 'kill_switch_off') AS bad FROM oe), t AS (SELECT *, bad AND coalesce(lag(bad) OVER w, false) AS two FROM b WINDOW w AS (PARTITION BY run_id ORDER BY ts, seq)),
  u AS (SELECT *, coalesce(lag(two) OVER (PARTITION BY run_id ORDER BY ts, seq), false) AS was FROM t) SELECT run_id, seq, CASE WHEN two THEN 'opened' ELSE 'closed' END AS change FROM u WHERE (two AND NOT was) OR (NOT bad AND was)""")
def wn29_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bad samples of a run in a row open an incident, a good one closes it."""
    rows = books.ops_events(spark, sf_dir).withColumn("bad", F.col("kind").isin("reconciliation_mismatch", "kill_switch_off"))
    return ledger.incidents(rows, "run_id").select("run_id", "seq", "change")


@query(f"""WITH {SQL_EQUITY}, l AS (SELECT *, lag(equity) OVER w AS before, max(equity) OVER w AS peak FROM eq WINDOW w AS (PARTITION BY run_id ORDER BY ts))
  SELECT run_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(before, 4) AS day_start, round(peak, 4) AS peak, round(equity / peak - 1, 6) AS drawdown, round(coalesce(equity / nullif(before, 0) - 1, 0), 6) AS daily_pnl FROM l""")
def wn30_equity_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ledger.equity_state(books.equity(spark, sf_dir), "run_id")
    return e.select("run_id", text("ts"), F.round("day_start", 4).alias("day_start"), F.round("peak", 4).alias("peak"), *r6(e, "drawdown", "daily_pnl"))


@query(f"WITH {SQL_OPS} SELECT run_id, coalesce(min(CASE WHEN kind = 'kill_switch_on' THEN row(ts, seq) END) < max(CASE WHEN kind = 'kill_switch_off' THEN row(ts, seq) END), false) AS tested FROM oe GROUP BY 1")
def ev7_switch_tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.switch_tested(books.ops_events(spark, sf_dir))


@query(f"WITH {SQL_RULES} SELECT rule, arg_max(status, row(ts, seq)) AS status, count(*) AS changes FROM re GROUP BY 1")
def ev3_current_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.current_state(books.rule_events(spark, sf_dir), "rule", ("ts", "seq"), "status")


@query(f"WITH {SQL_RULES}, l AS (SELECT *, lag(status) OVER (PARTITION BY rule ORDER BY ts, seq) AS from_status FROM re) SELECT rule, seq, from_status, status FROM l WHERE from_status IS NULL OR from_status <> status")
def ev3_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.transitions(books.rule_events(spark, sf_dir), "rule", ("ts", "seq")).select("rule", "seq", "from_status", "status")


@query(f"""WITH {SQL_EQUITY}, r AS (SELECT *, equity > lag(equity) OVER (PARTITION BY run_id ORDER BY ts) AS ready FROM eq), l AS (SELECT *, lag(ready) OVER (PARTITION BY run_id ORDER BY ts) AS before FROM r)
  SELECT run_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, ready FROM l WHERE before IS NOT NULL AND before <> ready""")
def ev6_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which equity turned from rising to falling, or back."""
    w = W.partitionBy("run_id").orderBy("ts")
    rows = books.equity(spark, sf_dir).withColumn("ready", F.col("equity") > F.lag("equity").over(w))
    return ledger.flips(rows, "run_id", ("ts",)).select("run_id", text("ts"), "ready")


def _forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = books.round_trips(spark, sf_dir).where("book = 'shadow'")
    rules = books.rule_events(spark, sf_dir).select("seq", "rule")
    return trips.join(rules, "seq")


@query()
def ev1_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.evidence(_forward(spark, sf_dir), "rule")


@query()
def ev2_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = ledger.current_state(books.rule_events(spark, sf_dir), "rule", ("ts", "seq"), "status", "ts").withColumnRenamed("ts", "updated_at")
    now = current.agg(F.max("updated_at").alias("now"))
    return ledger.review(current.crossJoin(F.broadcast(now)), stats.evidence(_forward(spark, sf_dir), "rule"), F.col("now"))


@query(f"""WITH {SQL_TRIPS}, {SQL_RULES}, f AS (SELECT rule, {PAYOFF} FROM rt JOIN re ON rt.seq = re.seq WHERE book = 'shadow' GROUP BY 1)
  SELECT rule, n, wins, round(mean, 6) AS mean, round(avg_win, 6) AS avg_win, round(avg_loss, 6) AS avg_loss, round(mean / (sd / sqrt(n)), 6) AS t, round((1.0 + wins) / (2 + n), 6) AS p_win, round(sqrt((1.0 + wins) * (1 + n - wins) / ((2.0 + n) * (2 + n) * (3 + n))), 6) AS p_win_sd, round(avg_loss / nullif(avg_win + avg_loss, 0), 6) AS breakeven FROM f""")
def sc12_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests and posteriors of every rule's forward returns; the tail functions are held against known values in tests."""
    g = stats.posterior(stats.mean_test(stats.payoffs(_forward(spark, sf_dir), "rule")))
    return g.select("rule", "n", "wins", *r6(g, "mean", "avg_win", "avg_loss", "t", "p_win", "p_win_sd", "breakeven"))


@query()
def sc13_tail_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stats.posterior(stats.mean_test(stats.payoffs(_forward(spark, sf_dir), "rule")))
    return g.select("rule", "p", "ci_low", "ci_high", "p_win_low", "p_win_high", "p_positive")


@query(f"""WITH {SQL_TRIPS}, g AS (SELECT strategy, {PAYOFF} FROM rt GROUP BY 1)
  SELECT strategy, round(CASE WHEN mean <= 0 THEN 0 ELSE 100 * 0.9 * least(1, n / 30.0) * CASE WHEN avg_loss > 0 THEN tanh(mean / (avg_loss + 1e-9)) ELSE 1 END * 0.8 END, 6) AS edge_score FROM g""")
def sc15_edge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge scores at a stated p-value (0.1) and chance of a positive mean (0.8)."""
    g = stats.payoffs(books.round_trips(spark, sf_dir), "strategy")
    return g.select("strategy", F.round(stats.edge_score(F.col("n"), F.col("mean"), F.col("avg_loss"), F.lit(0.1), F.lit(0.8)), 6).alias("edge_score"))


@query(f"""WITH {SQL_TRIPS}, c AS (SELECT run_id, arg_max(symbol, row(exit_ts, seq)) AS regime FROM rt GROUP BY 1), g AS (SELECT run_id, symbol AS regime, count(*) AS n, avg(net_return) AS mean FROM rt WHERE strategy = '5-LOW' GROUP BY 1, 2)
  SELECT c.run_id, CAST(CASE WHEN n IS NULL OR n < 5 THEN 0.5 WHEN mean > 0 THEN 1 ELSE 0 END AS DOUBLE) AS compatibility FROM c LEFT JOIN g ON g.run_id = c.run_id AND g.regime = c.regime""")
def sc16_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = books.round_trips(spark, sf_dir).withColumn("regime", F.col("symbol"))
    current = trips.groupBy("run_id").agg(F.max_by("regime", F.struct("exit_ts", "seq")).alias("regime"))
    return stats.regime_compatibility(stats.payoffs(trips.where("strategy = '5-LOW'"), "run_id", "regime"), current, "run_id")


@query(f"WITH {SQL_TRIPS}, {SQL_RULES} SELECT * FROM (SELECT CAST(epoch_us(exit_ts) AS BIGINT) AS us, 'trade' AS kind, seq FROM rt ORDER BY exit_ts DESC, seq DESC LIMIT 15) UNION ALL SELECT * FROM (SELECT CAST(epoch_us(ts) AS BIGINT), 'rule', seq FROM re ORDER BY ts DESC, seq DESC LIMIT 10) ORDER BY us DESC, kind, seq DESC LIMIT 20")
def tk5_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest trades and rule changes, each up to its own limit, merged."""
    sources = {"trade": (books.round_trips(spark, sf_dir).select(F.col("exit_ts").alias("ts"), "seq", F.col("strategy").alias("text")), 15), "rule": (books.rule_events(spark, sf_dir).select("ts", "seq", F.col("status").alias("text")), 10)}
    return ledger.activity_feed(sources, 20).select(F.unix_micros("ts").alias("us"), "kind", "seq")


@query(f"WITH {SQL_TRIPS} SELECT seq, strategy FROM rt WHERE book = 'paper' ORDER BY exit_ts DESC, seq DESC LIMIT 50")
def tk7_latest_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(books.round_trips(spark, sf_dir).where("book = 'paper'"), 50, "exit_ts", "seq").select("seq", "strategy")


@query(f"""WITH {SQL_TRIPS}, g AS (SELECT strategy || '/' || symbol || '/' || run_id AS rule, round(avg(net_return) * 1000, 6) AS edge_score, max(net_return) AS best FROM rt GROUP BY strategy, symbol, run_id)
  SELECT rule, edge_score, CAST(row_number() OVER (ORDER BY edge_score DESC, rule) AS INTEGER) AS place FROM g WHERE edge_score > 0 QUALIFY place <= (SELECT greatest(0, 8 - count(DISTINCT book)) FROM rt)""")
def tk6_promotion_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = books.round_trips(spark, sf_dir)
    found = trips.groupBy(F.concat_ws("/", "strategy", "symbol", "run_id").alias("rule")).agg(F.round(F.avg("net_return") * 1000, 6).alias("edge_score")).where("edge_score > 0")
    return ledger.promotions(found, trips.agg(F.greatest(F.lit(0), 8 - F.count_distinct("book")).alias("slots")))


@query("""SELECT p_name || p_partkey AS symbol, p_retailprice AS volume FROM part WHERE p_name NOT LIKE 'small%' AND p_name LIKE '%ring' ORDER BY p_retailprice DESC, symbol DESC LIMIT 20""")
def tk1_liquid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest volume among names with the wanted suffix and none of the excluded bases, ties to the later name."""
    p = views.table(spark, sf_dir, "part").where(F.col("p_name").endswith("ring") & ~F.col("p_name").startswith("small"))
    rows = p.select(F.concat("p_name", "p_partkey").alias("symbol"), F.col("p_retailprice").alias("volume"))
    return rows.orderBy(F.desc("volume"), F.desc("symbol")).limit(20)


@query(f"""WITH {SQL_TRIPS}, g AS (SELECT strategy, symbol, run_id, avg(net_return) AS ev, avg(net_return) > 0.0005 AS candidate FROM rt GROUP BY 1, 2, 3) SELECT strategy, symbol, run_id, CAST(row_number() OVER (ORDER BY candidate DESC, round(ev, 9) DESC, strategy, symbol, run_id) AS INTEGER) AS place FROM g""")
def tk2_study_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates first, then by expected value: a row a pair, ranked in one ordered pass."""
    g = books.round_trips(spark, sf_dir).groupBy("strategy", "symbol", "run_id").agg(F.avg("net_return").alias("ev"))
    order = W.orderBy(F.desc(F.col("ev") > 0.0005), F.desc(F.round("ev", 9)), "strategy", "symbol", "run_id")
    return g.select("strategy", "symbol", "run_id", F.row_number().over(order).alias("place"))


@query(f"WITH {SQL_TRIPS}, g AS (SELECT strategy, symbol, run_id, round(avg(net_return), 9) AS ev FROM rt GROUP BY 1, 2, 3) SELECT * FROM g ORDER BY ev DESC, strategy, symbol, run_id LIMIT 10")
def tk4_top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = books.round_trips(spark, sf_dir).groupBy("strategy", "symbol", "run_id").agg(F.round(F.avg("net_return"), 9).alias("ev"))
    return g.orderBy(F.desc("ev"), "strategy", "symbol", "run_id").limit(10)


# Screening

SQL_PROFILE = ", ".join(f"{'least' if n in desk.AT_MOST else 'greatest'}({f'round_even({lo} + {hi - lo} * level / 100, 0)' if n in ('max_positions', 'max_consecutive_losses') else f'{lo} + ({hi - lo}) * level / 100.0'}, {desk.AT_MOST.get(n, desk.AT_LEAST.get(n))}) AS {n}" for n, (lo, hi) in desk.PROFILE.items())


@query(f"WITH l AS (SELECT DISTINCT CAST(o_custkey % 101 AS DOUBLE) AS level FROM orders) SELECT level, {', '.join(f'round(CAST({n} AS DOUBLE), 6) AS {n}' for n in desk.PROFILE)} FROM (SELECT level, {SQL_PROFILE} FROM l)")
def sc8_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = views.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 101).cast("double").alias("level")).distinct()
    rows = levels.withColumns(desk.profile(F.col("level")))
    return rows.select("level", *(F.round(F.col(n).cast("double"), 6).alias(n) for n in desk.PROFILE))


SQL_SCREEN = f"""o AS (SELECT o_orderkey AS seq, o_orderkey AS k, o_custkey AS c, o_orderstatus AS symbol, o_orderpriority AS strategy, o_totalprice / 1000 AS bid, o_totalprice / 1000 * (1 + (o_orderkey % 8) * CAST(0.0005 AS DOUBLE)) AS ask, CAST(10000 AS DOUBLE) + o_custkey AS equity, (o_custkey % 5) * 25 AS level FROM orders),
  s AS (SELECT *, ask * (1 - (k % 9) * CAST(0.01 AS DOUBLE)) AS stop, CASE WHEN k % 3 = 0 THEN CAST(2 AS DOUBLE) ELSE 0 END AS held, (k % 6) * CAST(0.0005 AS DOUBLE) AS slippage, (c % 50) * CAST(1000 AS DOUBLE) AS adv, equity * (c % 8) / 10 AS positions_value, equity * (10 - c % 8) / 10 AS cash,
    CAST(0.5 AS DOUBLE) + (c % 5) / 20 AS p_win, CAST(0.03 AS DOUBLE) AS avg_win, CAST(0.01 AS DOUBLE) + (k % 4) / 100 AS avg_loss, (ask - bid) / ((bid + ask) / 2) AS spread, k % 5 = 0 AS sell, k % 13 <> 0 AS known, {SQL_PROFILE} FROM o)"""


SQL_CHECKS = [
    ("kill_switch", "true", "k % 211 <> 0"), ("api_health", "true", "k % 199 <> 0"), ("reconciliation", "true", "k % 197 <> 0"), ("stale_data", "true", "k % 1000 <= 900"), ("trading_hours", "true", "k % 17 <> 0"), ("duplicate_order", "true", "k % 89 <> 0"), ("symbol_match", "true", "k % 101 <> 0"),
    ("valid_quote", "true", "bid > 0 AND ask >= bid"), ("no_short_selling", "sell", "held > 0"), ("max_daily_loss", "NOT sell", "(c % 60 - 10) / 1000 > -max_daily_loss"), ("max_drawdown", "NOT sell", "-(c % 12) / 100 > -max_drawdown"), ("consecutive_losses", "NOT sell", "c % 6 < max_consecutive_losses"),
    ("max_positions", "NOT sell", "held > 0 OR c % 5 < max_positions"), ("max_spread", "NOT sell", "spread <= max_spread_pct"), ("max_slippage", "NOT sell", "slippage <= max_slippage_pct"), ("min_liquidity", "NOT sell", "adv > 0"), ("evidence", "NOT sell AND NOT known", "false"),
    ("evidence_strategy", "NOT sell AND known", "k % 29 <> 0"), ("min_edge_score", "NOT sell AND known", "k % 100 >= min_edge_score"), ("min_confidence", "NOT sell AND known", "0.75 + 0.25 * (c % 11) / 10 >= min_confidence"),
    ("min_expected_net_edge", "NOT sell AND known", "(k % 40) / 1000 - spread - 2 * slippage - 0.003 >= min_expected_net_edge"), ("valid_stop", "NOT sell", "stop > 0 AND stop < ask"),
]


@query(f"""WITH {SQL_SCREEN}, f AS (SELECT *, list_filter([{', '.join(f"CASE WHEN ({a}) AND NOT ({p}) THEN '{n}' END" for n, a, p in SQL_CHECKS)}], lambda x: x IS NOT NULL) AS failed FROM s),
  q0 AS (SELECT *, CASE WHEN len(failed) = 0 AND NOT sell THEN least(equity * risk_per_trade / ((ask - stop) / ask), equity * greatest(0, p_win - (1 - p_win) * avg_loss / avg_win) * kelly_coefficient) END AS want FROM f),
  q1 AS (SELECT *, want > equity * max_position_pct - held * bid AS a1, CASE WHEN want > equity * max_position_pct - held * bid THEN greatest(equity * max_position_pct - held * bid, 0) ELSE want END AS n1 FROM q0),
  q2 AS (SELECT *, n1 > equity * max_portfolio_exposure - positions_value AS a2, CASE WHEN n1 > equity * max_portfolio_exposure - positions_value THEN greatest(equity * max_portfolio_exposure - positions_value, 0) ELSE n1 END AS n2 FROM q1),
  q3 AS (SELECT *, n2 > cash - equity * cash_reserve AS a3, CASE WHEN n2 > cash - equity * cash_reserve THEN greatest(cash - equity * cash_reserve, 0) ELSE n2 END AS n3 FROM q2),
  q4 AS (SELECT *, n3 > adv * ask * 0.005 AS a4, CASE WHEN n3 > adv * ask * 0.005 THEN greatest(adv * ask * 0.005, 0) ELSE n3 END AS n4 FROM q3),
  q5 AS (SELECT *, floor(n4 / ask / 0.01) * 0.01 AS qty FROM q4), q6 AS (SELECT *, len(failed) = 0 AND (sell OR qty * ask >= 1) AS fine FROM q5)
  SELECT seq, CASE WHEN NOT fine THEN 'REJECT' WHEN NOT sell AND (a1 OR a2 OR a3 OR a4) THEN 'ADJUST_SIZE' ELSE 'APPROVE' END AS action, round(CASE WHEN NOT fine THEN 0 WHEN sell THEN held ELSE qty END, 4) AS quantity,
    array_to_string(CASE WHEN len(failed) = 0 AND NOT sell AND qty * ask < 1 THEN ['min_order_notional'] ELSE failed END, ',') AS failed FROM q6""")
def rk1_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.screen(books.screening_orders(spark, sf_dir)).select("seq", "action", F.round("quantity", 4).alias("quantity"), F.concat_ws(",", "failed").alias("failed"))


@query(f"""WITH {SQL_SCREEN}, f AS (SELECT unnest(list_filter([{', '.join(f"CASE WHEN ({a}) AND NOT ({p}) THEN '{n}' END" for n, a, p in SQL_CHECKS)}], lambda x: x IS NOT NULL)) AS check_name FROM s) SELECT check_name, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, check_name LIMIT 5""")
def ag12_failed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent failures before sizing."""
    failed = F.transform(F.filter("checks", lambda x: ~x["passed"]), lambda x: x["name"])
    sets = desk.checked(books.screening_orders(spark, sf_dir)).groupBy(failed.alias("failed")).agg(F.count("*").alias("n"))
    rows = sets.select(F.explode("failed").alias("check_name"), "n")
    return rows.groupBy("check_name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "check_name").limit(5)


@query(f"""WITH {SQL_SCREEN} SELECT seq, CASE WHEN stop >= ask THEN 'stop above entry' END AS size_error, round(greatest(0, p_win - (1 - p_win) * avg_loss / avg_win), 6) AS full_kelly, round(equity * risk_per_trade / nullif((ask - stop) / ask, 0), 7) AS risk_notional,
  CASE WHEN stop < ask THEN CASE WHEN equity * greatest(0, p_win - (1 - p_win) * avg_loss / avg_win) * kelly_coefficient < equity * risk_per_trade / nullif((ask - stop) / ask, 0) THEN 'fractional_kelly' ELSE 'risk_per_trade' END END AS limited_by FROM s""")
def sc7_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books.screening_orders(spark, sf_dir).withColumns(desk.sizing())
    return rows.select("seq", "size_error", F.round("full_kelly", 6).alias("full_kelly"), F.round("risk_notional", 7).alias("risk_notional"), "limited_by")


@query("""WITH p AS (SELECT o_custkey AS account, o_orderstatus AS symbol, sum(o_orderkey % 5) AS q, avg(o_totalprice) AS price FROM orders GROUP BY 1, 2), v AS (SELECT account, sum(q * price) AS value, count(*) FILTER (q > 0) AS open_positions FROM p GROUP BY 1)
  SELECT account, round(value, 5) AS positions_value, round(1000000 + value, 5) AS equity, round(value / (1000000 + value), 6) AS exposure, round((1000000 + value) / greatest(1500000, 1000000 + value) - 1, 6) AS drawdown, round((1000000 + value) / 1200000 - 1, 6) AS daily_pnl, CAST(open_positions AS INTEGER) AS open_positions FROM v""")
def rk2_portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    held = o.groupBy(F.col("o_custkey").alias("account"), F.col("o_orderstatus").alias("symbol")).agg(F.sum(F.col("o_orderkey") % 5).cast("double").alias("quantity"), F.avg("o_totalprice").alias("market_price"))
    book = held.groupBy("account").agg(F.map_from_entries(F.collect_list(F.struct("symbol", F.struct("quantity", "market_price")))).alias("positions"))
    rows = book.withColumns({"cash": F.lit(1e6), "equity_peak": F.lit(1.5e6), "day_start": F.lit(1.2e6)}).withColumns(desk.portfolio_values())
    return rows.select("account", F.round("positions_value", 5).alias("positions_value"), F.round("equity", 5).alias("equity"), *r6(rows, "exposure", "drawdown", "daily_pnl"), "open_positions")


@query()
def rk3_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which trades a throttle would have let through as orders of one account a symbol, held against a loop in tests."""
    t = views.trades(spark, sf_dir).select(F.col("symbol").alias("account"), (F.col("seq") % 5).cast("string").alias("symbol"), "ts", "seq")
    return ledger.throttle(t, "account", 6, 1800.0).select("account", "seq", "accepted")


SQL_NY = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"


@query(f"""WITH {SQL_TRADES}, l AS (SELECT seq, {SQL_NY} AS l FROM tr), o AS (SELECT seq, isodow(l) < 6 AND CAST(l AS DATE) <> DATE '2024-01-15' AND CAST(l AS TIME) >= TIME '09:30:00' AND CAST(l AS TIME) < TIME '16:00:00' AS is_open, epoch_us(CAST(l AS DATE) + INTERVAL 16 HOUR) - epoch_us(l) AS us FROM l)
  SELECT seq, is_open, CASE WHEN is_open THEN round(us / 1e6, 6) END AS seconds_to_close, coalesce(is_open AND us / 1e6 > 900, false) AS may_enter, coalesce(is_open AND us / 1e6 <= 300, false) AS must_flatten FROM o""")
def sc9_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.trades(spark, sf_dir).withColumns(desk.session_bounds(F.col("ts"), ("2024-01-15",)))
    gates = desk.session_gates(F.col("seconds_to_close"), F.lit(False))
    return rows.select("seq", "is_open", F.round("seconds_to_close", 6).alias("seconds_to_close"), *(F.coalesce(v, F.lit(False)).alias(n) for n, v in gates.items()))


@query(f"""WITH {SQL_TRADES}, l AS (SELECT DISTINCT CAST({SQL_NY} AS DATE) AS d FROM tr), n AS (SELECT d, (SELECT min(x) FROM (SELECT d + CAST(k AS INTEGER) AS x FROM range(1, 11) AS r(k)) WHERE isodow(x) < 6 AND x <> DATE '2024-01-15') AS x FROM l)
  SELECT CAST(d AS VARCHAR) AS day, strftime((x + INTERVAL 570 MINUTE) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS next_open FROM n""")
def rk4_next_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each New York day with trades is over: the next time the session opens."""
    days = views.trades(spark, sf_dir).select(F.to_date(F.from_utc_timestamp("ts", "America/New_York")).alias("d")).distinct()
    evening = F.to_utc_timestamp(F.timestamp_seconds(F.unix_timestamp(F.col("d").cast("timestamp")) + 20 * 3600), "America/New_York")
    return days.select(F.col("d").cast("string").alias("day"), F.date_format(desk.session_bounds(evening, ("2024-01-15",))["next_open"], "yyyy-MM-dd HH:mm:ss").alias("next_open"))


@query("""WITH o AS (SELECT o_orderkey AS seq, o_totalprice AS price, (o_orderkey % 10) * 0.0001 AS spread, (o_custkey % 5) * 0.0001 AS slip, 0.001 + CASE WHEN o_orderstatus = 'F' THEN 0.0015 ELSE 0 END + 1.0 / o_totalprice AS side FROM orders)
  SELECT seq, round(price * (1 + spread / 2 + slip), 8) AS buy_price, round(price * (1 - spread / 2 - slip) * (1 - side), 8) AS effective_sell, round(spread + 2 * slip + 2 * side, 8) AS round_trip FROM o""")
def sc6_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders").withColumn("price", F.col("o_totalprice"))
    fx = desk.fx_cost(F.when(F.col("o_orderstatus") == "F", "usd").otherwise("EUR"), F.lit("EUR"))
    side = desk.side_cost(F.lit(0.001), fx, F.lit(1.0), F.col("o_totalprice"))
    rows = o.withColumns(desk.trade_costs((F.col("o_orderkey") % 10) * 0.0001, (F.col("o_custkey") % 5) * 0.0001, side))
    return rows.select(F.col("o_orderkey").alias("seq"), F.round("buy_price", 8).alias("buy_price"), F.round("effective_sell", 8).alias("effective_sell"), F.round("round_trip", 8).alias("round_trip"))


@query("""WITH a AS (SELECT l_suppkey AS symbol, sum(l_quantity) AS quantity FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1), b AS (SELECT l_suppkey AS symbol, sum(l_quantity) AS quantity FROM lineitem WHERE l_linenumber <= 4 AND l_orderkey % 1000 <> 7 GROUP BY 1)
  SELECT coalesce(a.symbol, b.symbol) AS symbol, a.quantity AS left_value, b.quantity AS right_value FROM a FULL JOIN b ON a.symbol = b.symbol WHERE a.quantity IS NULL OR b.quantity IS NULL OR abs(a.quantity - b.quantity) > 1e-9 * greatest(abs(a.quantity), abs(b.quantity))""")
def jn10_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose booked quantity differs from the one of a book that misses some orders."""
    li = views.table(spark, sf_dir, "lineitem").where("l_linenumber <= 4")
    book = lambda rows: rows.groupBy(F.col("l_suppkey").alias("symbol")).agg(F.sum("l_quantity").alias("quantity"))
    return joins.reconcile(book(li), book(li.where("l_orderkey % 1000 <> 7")))


@query(f"WITH {SQL_TRADES} SELECT tr.seq, symbol, CASE WHEN n.n_name IS NULL THEN 'unknown' ELSE n.n_name END AS venue, coalesce(n.n_regionkey > 1, false) AS tradable FROM tr LEFT JOIN events e ON e.event_id = tr.seq LEFT JOIN nation n ON n.n_nationkey = e.user_id % 30")
def jn6_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with the venue of their user: a small dimension, sent to every task; what it lacks is not tradable."""
    e = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 30).alias("k"))
    n = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey")
    rows = views.trades(spark, sf_dir).join(e, "seq").join(n.hint("broadcast"), "k", "left")
    return rows.select("seq", "symbol", F.coalesce("n_name", F.lit("unknown")).alias("venue"), F.coalesce(F.col("n_regionkey") > 1, F.lit(False)).alias("tradable"))


@query("SELECT CAST(count(*) AS BIGINT) AS cited, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM documents WHERE doc_id = event_id)) AS BIGINT) AS known FROM events WHERE event_type = 'purchase'")
def jn8_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases that cite a document number, and how many of these exist."""
    e = views.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("doc_id"))
    known = e.join(views.table(spark, sf_dir, "documents"), "doc_id", "left_semi")
    return e.agg(F.count("*").alias("cited")).crossJoin(known.agg(F.count("*").alias("known")))


@query(f"WITH {SQL_QUOTES} SELECT ts_us, kind, seq, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts_us, kind, seq) AS INTEGER) AS place FROM (SELECT symbol, epoch_us(ts) AS ts_us, 'Q' AS kind, seq FROM qu UNION ALL SELECT symbol, epoch_us(ts), 'T', seq FROM tr)")
def jn9_merged_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes and trades as one feed in order of time (ST-U1: a union of kinds)."""
    own = lambda df, kind: df.select("symbol", F.unix_micros("ts").alias("ts_us"), F.lit(kind).alias("kind"), "seq")
    both = own(views.quotes(spark, sf_dir), "Q").unionByName(own(views.trades(spark, sf_dir), "T"))
    return both.select("ts_us", "kind", "seq", F.row_number().over(W.partitionBy("symbol").orderBy("ts_us", "kind", "seq")).alias("place"))


@query(f"WITH {SQL_BARS}, d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM b)) SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS frontier, n AS stamps FROM d WHERE i = CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT)")
def jn11_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timestamp at 70 percent of the panel's distinct timestamps."""
    stamps = views.bars_1d(spark, sf_dir).select("ts").distinct()
    # Sorted by range, numbered by partition sizes: no single task sees all stamps.
    placed = stamps.repartitionByRange("ts").sortWithinPartitions("ts").withColumn("part", F.spark_partition_id())
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    starts = sizes.select("part", (F.sum("n").over(W.orderBy("first")) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy()).alias("stamps"))
    rows = placed.withColumn("i", F.row_number().over(W.partitionBy("part").orderBy("ts")) - 1).join(F.broadcast(starts), "part")
    return rows.where(F.col("i") + F.col("before") == F.floor(F.col("stamps") * F.lit(0.7))).select(F.to_date("ts").cast("string").alias("frontier"), "stamps")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
  SELECT 'added' AS change, k FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'removed', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'kept', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)""")
def stu3_set_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys added, removed and kept between two sets (ST-U3, ST-U4)."""
    o = views.table(spark, sf_dir, "orders")
    keys = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")).distinct()
    both = keys("F").withColumn("a", F.lit(True)).join(keys("O").withColumn("b", F.lit(True)), "k", "full_outer")
    return both.select(F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("kept").alias("change"), "k")


@query(f"WITH {SQL_TRADES}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol, date_trunc('minute', ts) ORDER BY ts DESC, seq DESC) AS k FROM tr) SELECT symbol, seq FROM k WHERE k = 1")
def stu2_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trade a symbol and minute, the last."""
    w = W.partitionBy("symbol", F.date_trunc("minute", "ts")).orderBy(F.desc("ts"), F.desc("seq"))
    return views.trades(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k = 1").select("symbol", "seq")
