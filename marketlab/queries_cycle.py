"""Registered queries of research cycles and briefings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.functions.columns import HEADLINE_KINDS
from marketlab.operators import briefing, cycle
from marketlab.queries import SQL_BARS, SQL_TRADES, query
from marketlab.queries_streams import SQL_SHADOW, _signals
from marketlab.sources import books, views
from marketlab.sources.books import SQL_TRIPS
from marketlab.sources.store import settled

c = F.col

# --- cycles: round trips by run stand for timeframes

SQL_PAIRS = SQL_TRIPS + """, pg AS (SELECT run_id AS timeframe, symbol, strategy, count(*) AS n, round(avg(net_return), 9) AS ev FROM rt GROUP BY 1, 2, 3),
  pr AS (SELECT timeframe, symbol, strategy, CASE WHEN n % 10 <> 0 THEN n % 7 + 1 END AS n_hypotheses, CASE WHEN n % 10 = 0 THEN 'ERROR' WHEN ev > 0.0005 THEN 'CHALLENGER_CANDIDATE' ELSE 'REJECTED' END AS decision, CASE WHEN n % 6 <> 0 THEN ev END AS oos_ev, n AS oos_trades,
    list_filter([CASE WHEN ev <= 0 THEN 'edge' END, CASE WHEN n < 200 THEN 'few' END, CASE WHEN n % 3 = 0 THEN 'luck' END, CASE WHEN n % 2 = 1 THEN 'odd' END, CASE WHEN n % 5 < 2 THEN 'regime' END, CASE WHEN symbol = 'P' THEN 'thin' END], lambda x: x IS NOT NULL) AS failed FROM pg)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, ev = c("n"), c("ev")
    g = books.round_trips(spark, sf_dir).groupBy(c("run_id").alias("timeframe"), "symbol", "strategy").agg(F.count("*").alias("n"), F.round(F.avg("net_return"), 9).alias("ev"))
    checks = {"edge": ev <= 0, "few": n < 200, "luck": n % 3 == 0, "odd": n % 2 == 1, "regime": n % 5 < 2, "thin": c("symbol") == "P"}
    decision = F.when(n % 10 == 0, "ERROR").when(ev > 0.0005, cycle.CANDIDATE).otherwise("REJECTED")
    return g.select("timeframe", "symbol", "strategy", F.when(n % 10 != 0, n % 7 + 1).alias("n_hypotheses"), decision.alias("decision"), F.when(n % 6 != 0, ev).alias("oos_ev"), n.alias("oos_trades"), F.array_compact(F.array(*(F.when(test, F.lit(k)) for k, test in checks.items()))).alias("failed"))


SQL_SUMMARY = "count(*) AS pairs, count(n_hypotheses) AS studied, CAST(coalesce(sum(n_hypotheses), 0) AS BIGINT) AS hypotheses, count(*) FILTER (decision = 'CHALLENGER_CANDIDATE') AS candidates FROM pr"


@query(f"WITH {SQL_PAIRS} SELECT timeframe, {SQL_SUMMARY} GROUP BY 1 UNION ALL SELECT '*', {SQL_SUMMARY}")
def rs11_cycle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cycle studied, by timeframe and in all."""
    p = settled(_pairs(spark, sf_dir), "pairs")
    return cycle.cycle_summary(p, "timeframe").unionByName(cycle.cycle_summary(p).withColumn("timeframe", F.lit("*"))).drop("discoveries")


@query(f"WITH {SQL_PAIRS}, f AS (SELECT timeframe, unnest(failed) AS \"check\" FROM pr WHERE n_hypotheses IS NOT NULL), g AS (SELECT timeframe, \"check\", count(*) AS n FROM f GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY timeframe ORDER BY n DESC, \"check\") AS place FROM g")
def rs11_failed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which checks pairs fail most, by timeframe."""
    return cycle.failed_checks(_pairs(spark, sf_dir), "timeframe")


@query(f"""WITH {SQL_BARS}, {SQL_TRADES}, a AS (SELECT '1d' AS timeframe, symbol, ts FROM b UNION ALL SELECT DISTINCT '1h', symbol, date_trunc('hour', ts) FROM tr)
  SELECT timeframe, symbol, count(*) AS bars, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM a GROUP BY 1, 2""")
def rs11_bar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bars a cycle has of every timeframe and symbol."""
    both = views.bars_1d(spark, sf_dir).select("timeframe", "symbol", "ts").unionByName(views.bars_1h(spark, sf_dir).select("timeframe", "symbol", "ts"))
    return cycle.bar_counts(both).select("timeframe", "symbol", "bars", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


SQL_LATE = SQL_SHADOW.replace("FROM tr WHERE seq % 4 = 0)", "FROM tr WHERE seq % 4 = 0 AND ts >= CASE seq % 3 WHEN 0 THEN TIMESTAMP '2024-01-10 00:00:00' ELSE TIMESTAMP '2024-01-20 00:00:00' END)").replace("\n  SELECT a.symbol, a.strategy,", ",\n  fin AS (SELECT a.symbol, a.strategy,")


@query(f"""WITH RECURSIVE {SQL_LATE}), k AS (SELECT strategy, count(*) AS n, avg(net_return) AS m, avg(CAST(net_return > 0 AS INTEGER)) AS w FROM fin GROUP BY 1)
  SELECT s.strategy, coalesce(n, 0) AS n_trades, round(coalesce(m, 0), 6) AS mean_net_return, round(coalesce(w, 0), 6) AS win_rate, coalesce(n >= 5 AND m > 0, false) AS passed FROM (VALUES ('quick'), ('slow'), ('silent')) AS s(strategy) LEFT JOIN k ON k.strategy = s.strategy""")
def rs12_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates traded on rough quotes over the days that did not choose them; one has no signals."""
    t = views.trades(spark, sf_dir)
    day = lambda n: dt.datetime(2024, 1, n, tzinfo=dt.timezone.utc)
    candidates = spark.createDataFrame([("quick", day(10)), ("slow", day(20)), ("silent", day(1))], "strategy string, oos_start timestamp")
    got = cycle.confirm(candidates, _signals(t), views.rough_quotes(t).where("bid > 0 and ask >= bid"))
    return got.select("strategy", "n_trades", F.round("mean_net_return", 6).alias("mean_net_return"), F.round("win_rate", 6).alias("win_rate"), "passed")


@query(f"""WITH {SQL_PAIRS}, hy AS (SELECT DISTINCT strategy, CAST(strategy[1:1] AS INTEGER) AS hypothesis FROM rt UNION ALL SELECT 'never', 9), st AS (SELECT * FROM pr WHERE n_hypotheses IS NOT NULL),
  f AS (SELECT strategy, unnest(failed) AS name FROM st), g AS (SELECT strategy, name, count(*) AS n FROM f GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY n DESC, name) <= 4), w AS (SELECT strategy, string_agg(name || ':' || n, ',' ORDER BY n DESC, name) AS failed_checks FROM g GROUP BY 1),
  a AS (SELECT strategy, count(*) AS symbols_tested, arg_min(symbol, row(-coalesce(oos_ev, '-inf'::DOUBLE), timeframe, symbol)) AS best_symbol, first(oos_ev ORDER BY coalesce(oos_ev, '-inf'::DOUBLE) DESC, timeframe, symbol) AS best_oos_ev, first(oos_trades ORDER BY coalesce(oos_ev, '-inf'::DOUBLE) DESC, timeframe, symbol) AS best_oos_trades,
    count(*) FILTER (decision = 'CHALLENGER_CANDIDATE') AS candidates, coalesce(string_agg(strategy || ':' || symbol || ':' || timeframe, ',' ORDER BY strategy || ':' || symbol || ':' || timeframe) FILTER (decision = 'CHALLENGER_CANDIDATE'), '') AS rules, bool_or(decision = 'CHALLENGER_CANDIDATE' AND oos_trades % 4 = 0) AS promoted FROM st GROUP BY 1)
  SELECT hypothesis, hy.strategy, coalesce(symbols_tested, 0) AS symbols_tested, best_symbol, best_oos_ev, best_oos_trades, coalesce(candidates, 0) AS candidates, coalesce(rules, '') AS rules, coalesce(failed_checks, '') AS failed_checks, CASE WHEN promoted THEN 'promoted' ELSE 'rejected' END AS status
  FROM hy LEFT JOIN a ON a.strategy = hy.strategy LEFT JOIN w ON w.strategy = hy.strategy""")
def rs13_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cycle concludes about hypotheses, one of which was never tested."""
    p = settled(_pairs(spark, sf_dir), "pairs")
    hypotheses = p.select("strategy", F.substring("strategy", 1, 1).cast("int").alias("hypothesis")).distinct().unionByName(spark.createDataFrame([("never", 9)], "strategy string, hypothesis int"))
    rules = p.where(c("decision") == cycle.CANDIDATE).select("timeframe", "symbol", "strategy", F.concat_ws(":", "strategy", "symbol", "timeframe").alias("rule"), (c("oos_trades") % 4 == 0).alias("promoted"))
    got = cycle.write_back(hypotheses, p, rules)
    told = F.array_join(F.transform("failed_checks", lambda f: F.concat(f["check"], F.lit(":"), f["n"])), ",")
    return got.withColumns({"rules": F.array_join("rules", ","), "failed_checks": told})


# --- briefings: twenty documents are the headlines that one was shown

KINDS = [k for k, _ in HEADLINE_KINDS] + ["other"]
SQL_KIND = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{k}'" for k, p in HEADLINE_KINDS) + " ELSE 'other' END"
SQL_BRIEF = f"""d AS (SELECT CAST(doc_id AS BIGINT) AS id, CAST(doc_id // 20 AS BIGINT) AS briefing, upper(coalesce(lang, 'xx')) AS l, upper(coalesce(source, 'none')) AS s, {SQL_KIND} AS k FROM documents),
  e AS (SELECT d.*, row_number() OVER (PARTITION BY d.briefing ORDER BY d.id) - 1 AS pos, list_filter([n.id, CASE WHEN d.id % 5 <> 0 THEN d.id END], lambda x: x IS NOT NULL) AS ids, n.l AS nl, n.s AS ns, n.k AS nk, 2 + (d.id % 2) AS cited FROM d LEFT JOIN d AS n ON n.id = d.id + 1 AND n.briefing = d.briefing WHERE d.id % 3 = 0),
  v AS (SELECT *, list_filter([nl, ns, CASE WHEN id % 5 <> 0 THEN l END, CASE WHEN id % 5 <> 0 THEN s END], lambda x: x IS NOT NULL) AS allowed, [l, 'SRC3', 'ZZ'] AS asked, CASE WHEN id % 8 = 0 THEN 3 ELSE least(id % 8, 5) END AS importance,
    CASE WHEN briefing % 7 = 0 THEN 'no summary' WHEN len(ids) = 0 THEN 'no real headline' END AS problem FROM e),
  o AS (SELECT briefing, pos AS "at", CASE WHEN problem IS NULL THEN row_number() OVER (PARTITION BY briefing, problem IS NULL ORDER BY importance DESC, pos) END AS place, ids, array_to_string(ids, ',') AS headline_ids, array_to_string(list_filter(asked, lambda x: list_contains(allowed, x)), ',') AS symbols,
    CASE WHEN id % 4 = 0 THEN 'macro' WHEN nk IS NOT NULL THEN nk WHEN id % 5 <> 0 THEN k END AS kind, importance, s AS why, cited - len(ids) AS unknown_ids, len(list_filter(asked, lambda x: NOT list_contains(allowed, x))) AS invented, problem FROM v)"""


def _briefings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Briefings and what each was shown."""
    i = c("doc_id").cast("long")
    d = views.table(spark, sf_dir, "documents").select(i.alias("id"), F.floor(i / 20).cast("long").alias("briefing"), F.coalesce("lang", F.lit("xx")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"), "text")
    shown = d.select("briefing", "id", c("text").alias("headline"), F.array("lang", "source").alias("symbols"))
    i = c("id")
    # The next headline, which the briefing may not have seen, its own or one that nobody knows, and sometimes no number at all.
    cite = F.array_compact(F.array((i + 1).cast("string"), F.when(i % 5 == 0, "-1").otherwise(i.cast("string")), F.when(i % 2 == 1, "x")))
    event = F.struct(cite.alias("headline_ids"), F.array("lang", F.lit("src3"), F.lit("ZZ")).alias("symbols"), F.when(i % 4 == 0, "macro").otherwise("gossip").alias("type"), (i % 8).alias("importance"), F.upper("source").alias("why_it_matters"))
    listed = d.groupBy("briefing").agg(F.array_sort(F.collect_list(F.when(i % 3 == 0, F.struct("id", event.alias("e"))))).alias("_e"), F.array_sort(F.collect_set("lang")).alias("_l"))
    body = F.struct(F.when(c("briefing") % 7 == 0, " ").otherwise("calm").alias("market_summary"), F.transform("_e", lambda x: x["e"]).alias("events"), F.concat("_l", F.array(F.lit("zz"))).alias("watchlist"))
    made = F.timestamp_seconds(c("briefing") * 7 * 3600 + 1704067200)
    return settled(listed.select("briefing", made.alias("made_at"), F.to_json(body).alias("payload")), "briefings"), shown


@query(f"WITH {SQL_BRIEF} SELECT * EXCLUDE (ids) FROM o")
def ev9_briefing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of every briefing, with what its headlines support and what they do not."""
    rows, shown = _briefings(spark, sf_dir)
    got = briefing.checked_events(rows, shown, KINDS)
    return got.withColumns({"headline_ids": F.array_join(c("headline_ids").cast("array<string>"), ","), "symbols": F.array_join("symbols", ",")})


@query(f"WITH {SQL_BRIEF} SELECT briefing, string_agg(DISTINCT l, ',' ORDER BY l) AS watchlist, 1 AS invented FROM d GROUP BY 1")
def ev9_watchlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each watchlist its headlines name."""
    got = briefing.watchlists(*_briefings(spark, sf_dir))
    return got.withColumn("watchlist", F.array_join("watchlist", ","))


@query(f"""WITH {SQL_BRIEF}, y AS (SELECT briefing, timezone('America/New_York', timezone('UTC', TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(briefing * 7 AS INTEGER)))) AS local FROM d WHERE briefing % 7 <> 0 GROUP BY 1), z AS (SELECT min(briefing) AS briefing, CAST(local AS DATE) AS day FROM y GROUP BY 2),
  ci AS (SELECT briefing, count(DISTINCT id) AS cited FROM (SELECT briefing, unnest(ids) AS id FROM o WHERE place <= 8) GROUP BY 1) SELECT CAST(day AS VARCHAR) AS date, z.briefing, coalesce(cited, 0) AS cited FROM z LEFT JOIN ci ON ci.briefing = z.briefing""")
def ev10_daily_briefings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The briefing of each New York date, and how many headlines it keeps for its events."""
    rows, shown = _briefings(spark, sf_dir)
    days = briefing.one_a_day(rows)
    cited = briefing.cited_headlines(briefing.kept_events(briefing.checked_events(days, shown, KINDS)), shown).groupBy("briefing").agg(F.count("*").alias("cited"))
    return days.join(cited, "briefing", "left").select(c("date").cast("string").alias("date"), "briefing", F.coalesce("cited", F.lit(0)).alias("cited"))


# --- what a report may read

@query(f"""WITH {SQL_TRIPS}, le AS (SELECT o_orderkey AS seq, o_orderpriority || ' on ' || o_orderstatus AS text FROM orders ORDER BY 1 DESC LIMIT 15), ru AS (SELECT o_custkey % 50 AS seq, o_orderpriority || ':' || o_custkey AS name FROM orders WHERE o_custkey % 50 % 3 <> 0),
  la AS (SELECT DISTINCT name FROM ru WHERE seq = (SELECT max(seq) FROM ru) ORDER BY 1 LIMIT 8), fw AS (SELECT strategy || '/' || run_id AS strategy, count(*) AS n, avg(net_return) AS mean, avg(CAST(net_return > 0 AS INTEGER)) AS rate FROM rt WHERE book = 'shadow' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20),
  po AS (SELECT p_partkey AS seq, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'tested' ELSE 'new' END AS status, repeat(p_type || ' ', 20) AS claim FROM part ORDER BY 1 DESC LIMIT 20)
  SELECT 'lesson' AS part, CAST(row_number() OVER (ORDER BY seq DESC) AS INTEGER) AS place, CAST(NULL AS VARCHAR) AS name, text, CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS win_rate FROM le UNION ALL SELECT 'pair', CAST(row_number() OVER (ORDER BY name) AS INTEGER), name, NULL, NULL, NULL, NULL FROM la
  UNION ALL SELECT 'forward', CAST(row_number() OVER (ORDER BY n DESC, strategy) AS INTEGER), strategy, NULL, n, round(mean, 6), round(rate, 6) FROM fw UNION ALL SELECT 'proposal', CAST(row_number() OVER (ORDER BY seq DESC) AS INTEGER), name, status || ': ' || claim[1:160], NULL, NULL, NULL FROM po""")
def ev8_report_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest lessons, best pairs of the last done run, forward evidence and earlier proposals, as a report would read them."""
    o, p = views.table(spark, sf_dir, "orders"), views.table(spark, sf_dir, "part")
    lessons = o.select(c("o_orderkey").alias("seq"), F.concat_ws(" on ", "o_orderpriority", "o_orderstatus").alias("text"))
    run = c("o_custkey") % 50
    runs = o.groupBy(run.alias("seq")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "o_orderpriority", "o_custkey"))).alias("top_pairs")).withColumn("status", F.when(c("seq") % 3 == 0, "failed").otherwise("done"))
    trips = books.round_trips(spark, sf_dir).where("book = 'shadow'").withColumn("strategy", F.concat_ws("/", "strategy", "run_id"))
    proposals = p.select(c("p_partkey").alias("seq"), c("p_name").alias("name"), F.when(c("p_partkey") % 2 == 0, "tested").otherwise("new").alias("status"), F.repeat(F.concat("p_type", F.lit(" ")), F.lit(20)).alias("claim"))
    got = cycle.report_extract(lessons, runs, trips, proposals)
    return got.withColumns({"mean": F.round("mean", 6), "win_rate": F.round("win_rate", 6)})
