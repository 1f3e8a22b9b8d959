"""Registered queries of the event stream: tick bars, features, intents, shadow trades, in batch and as streams that end with what their sources hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.operators import bars, ticks
from marketlab.queries import SQL_TRADES, query
from marketlab.sources import views
from marketlab.sources.store import settled
from marketlab.streaming import stateful
from marketlab.streaming.bars import drain

HOUR = 3600
BAR_COLUMNS = ("open", "high", "low", "close", "volume", "buy_volume", "sell_volume", "n_trades", "last_bid", "last_ask", "bid_qty", "ask_qty")

SQL_ROUGH = SQL_TRADES + """, gq AS (SELECT *, (bid + ask) / 2 AS mid FROM (SELECT symbol, ts + CASE WHEN seq % 5 = 0 THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END AS ts, seq, CASE WHEN seq % 97 = 1 THEN 0 ELSE price * 0.9995 END AS bid,
    price * CASE seq % 11 WHEN 0 THEN CAST(0.999 AS DOUBLE) WHEN 5 THEN CAST(0.9995 AS DOUBLE) ELSE CAST(1.0005 AS DOUBLE) END AS ask, CAST(seq % 10 AS DOUBLE) AS bid_qty, CAST(seq * 7 % 10 AS DOUBLE) AS ask_qty FROM tr WHERE seq % 7 <> 3) WHERE bid > 0 AND ask >= bid)"""

SQL_TICK_BARS = SQL_ROUGH + """, fq AS (SELECT symbol, min(row(ts, seq)) AS first FROM gq GROUP BY 1),
  qb AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(mid, row(ts, seq)) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, row(ts, seq)) AS close, arg_max(bid, row(ts, seq)) AS last_bid, arg_max(ask, row(ts, seq)) AS last_ask, arg_max(bid_qty, row(ts, seq)) AS bid_qty, arg_max(ask_qty, row(ts, seq)) AS ask_qty FROM gq GROUP BY 1, date_trunc('hour', ts)),
  vb AS (SELECT tr.symbol, date_trunc('hour', ts) AS ts, sum(qty) AS volume, coalesce(sum(qty) FILTER (NOT buyer_is_maker), 0) AS buy_volume, coalesce(sum(qty) FILTER (buyer_is_maker), 0) AS sell_volume, count(*) AS n_trades FROM tr JOIN fq ON tr.symbol = fq.symbol AND row(ts, seq) >= first GROUP BY 1, date_trunc('hour', ts)),
  jb AS (SELECT symbol, ts, open, high, low, close, coalesce(volume, 0) AS volume, coalesce(buy_volume, 0) AS buy_volume, coalesce(sell_volume, 0) AS sell_volume, coalesce(n_trades, 0) AS n_trades, last_bid, last_ask, bid_qty, ask_qty FROM qb FULL JOIN vb USING (symbol, ts)),
  cb AS (SELECT symbol, ts, coalesce(open, last_value(close IGNORE NULLS) OVER s) AS open, coalesce(high, last_value(close IGNORE NULLS) OVER s) AS high, coalesce(low, last_value(close IGNORE NULLS) OVER s) AS low, last_value(close IGNORE NULLS) OVER s AS close, volume, buy_volume, sell_volume, n_trades,
    last_value(last_bid IGNORE NULLS) OVER s AS last_bid, last_value(last_ask IGNORE NULLS) OVER s AS last_ask, last_value(bid_qty IGNORE NULLS) OVER s AS bid_qty, last_value(ask_qty IGNORE NULLS) OVER s AS ask_qty FROM jb WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
  gb AS (SELECT *, (epoch(lead(ts) OVER s) - epoch(ts)) // 3600 - 1 AS missing, CAST((epoch(ts) - epoch(lag(ts) OVER s)) // 3600 - 1 > {most} AS INTEGER) AS gap FROM cb WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
  ob AS (SELECT *, coalesce(sum(gap) OVER (PARTITION BY symbol ORDER BY ts), 0) AS outages FROM gb),
  fb AS (SELECT symbol, ts, open, high, low, close, volume, buy_volume, sell_volume, n_trades, last_bid, last_ask, bid_qty, ask_qty, outages FROM ob UNION ALL
    SELECT symbol, ts + k * INTERVAL 1 HOUR, close, close, close, close, 0, 0, 0, 0, last_bid, last_ask, bid_qty, ask_qty, outages FROM (SELECT *, unnest(range(1, CAST(missing + 1 AS BIGINT))) AS k FROM ob WHERE missing BETWEEN 1 AND {most})),
  xb AS (SELECT * FROM fb QUALIFY ts < max(ts) OVER (PARTITION BY symbol))""".replace("{most}", "120")


def _rounded(df: DataFrame, *names: str, digits: int = 7) -> DataFrame:
    return df.select("symbol", F.col("ts").cast("string").alias("bar"), *(F.round(n, digits).alias(n) if dict(df.dtypes)[n] == "double" else F.col(n) for n in names))


def _sql_rounded(names: tuple[str, ...], exact: tuple[str, ...], source: str, digits: int = 7) -> str:
    return f"SELECT symbol, CAST(ts AS VARCHAR) AS bar, " + ", ".join(n if n in exact else f"round({n}, {digits}) AS {n}" for n in names) + f" FROM {source}"  # noqa: F541


def _features(rows: DataFrame) -> DataFrame:
    return _rounded(rows.withColumn("log_mean", F.log("rolling_mean")), *FEATURES)


def _closed(rows: DataFrame) -> DataFrame:
    """Without each symbol's last bar, which no later tick has closed."""
    last = rows.groupBy(F.col("symbol").alias("_s")).agg(F.max("ts").alias("_last"))
    return rows.join(last, rows["symbol"] == last["_s"]).where("ts < _last").drop("_s", "_last")


def _tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.trades(spark, sf_dir)
    return _closed(bars.fill_quiet(bars.tick_bars(views.rough_quotes(t), t, "1 hour"), HOUR))


SQL_SS2 = f"WITH {SQL_TICK_BARS} SELECT symbol, CAST(ts AS VARCHAR) AS bar, " + ", ".join(f"round({c}, 7) AS {c}" if c != "n_trades" else "n_trades" for c in BAR_COLUMNS) + ", CAST(outages AS BIGINT) AS outages FROM xb"


@query(SQL_SS2)
def ag2_book_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of rough quotes with flat ones for quiet hours, all columns (AG-2, SS-2 in batch)."""
    return _rounded(_tick_bars(spark, sf_dir), *BAR_COLUMNS, "outages")


@query(SQL_SS2)
def ss2_stream_tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the stream of events (SS-1, SS-2, SS-9)."""
    t = views.trade_stream(spark, sf_dir)
    return _rounded(drain(stateful.tick_bars(stateful.as_ticks(views.rough_quotes(t), t), HOUR), "tick-bars"), *BAR_COLUMNS, "outages")


#: The mean as a logarithm: averages of few prices end on ties of rounding.
FEATURES = ("ema_fast", "ema_slow", "sigma", "log_mean", "zscore", "momentum", "prior_high", "order_flow_imbalance", "book_imbalance", "spread_pct", "volume_per_second", "breakout", "bars_seen", "ready")
SQL_FEATURES = SQL_TICK_BARS + """, nb AS (SELECT *, row_number() OVER s AS i, CASE WHEN lag(close) OVER s > 0 THEN pow(ln(close / lag(close) OVER s), 2) END AS r2 FROM xb WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
  eb AS (SELECT symbol, i, close AS ema_fast, close AS ema_slow, CAST(NULL AS DOUBLE) AS v FROM nb WHERE i = 1 UNION ALL
    SELECT n.symbol, n.i, e.ema_fast + (2 / CAST(13 AS DOUBLE)) * (n.close - e.ema_fast), e.ema_slow + (2 / CAST(49 AS DOUBLE)) * (n.close - e.ema_slow), CASE WHEN n.r2 IS NULL THEN e.v WHEN e.v IS NULL THEN n.r2 ELSE e.v + (2 / CAST(61 AS DOUBLE)) * (n.r2 - e.v) END FROM eb AS e JOIN nb AS n ON n.symbol = e.symbol AND n.i = e.i + 1),
  wf AS (SELECT n.*, e.ema_fast, e.ema_slow, e.v, avg(close) OVER w60 AS rolling_mean, CASE WHEN max(close) OVER w60 > min(close) OVER w60 THEN stddev_pop(close) OVER w60 ELSE 0 END AS sd, lag(close, 12) OVER s AS past, coalesce(max(high) OVER p24, close) AS prior_high,
      sum(volume) OVER w12 AS flow, sum(buy_volume - sell_volume) OVER w12 AS signed, sum(volume) OVER w720 AS traded FROM nb AS n JOIN eb AS e ON e.symbol = n.symbol AND e.i = n.i
    WINDOW s AS (PARTITION BY n.symbol ORDER BY n.i), w60 AS (PARTITION BY n.symbol ORDER BY n.i ROWS 59 PRECEDING), w12 AS (PARTITION BY n.symbol ORDER BY n.i ROWS 11 PRECEDING), w720 AS (PARTITION BY n.symbol ORDER BY n.i ROWS 719 PRECEDING), p24 AS (PARTITION BY n.symbol ORDER BY n.i ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
  ft AS (SELECT *, sqrt(coalesce(v, 0)) AS sigma, CASE WHEN sd > 0 THEN (close - rolling_mean) / sd ELSE 0 END AS zscore, coalesce(close / past - 1, 0) AS momentum, i > 24 AND close > prior_high AS breakout, CASE WHEN flow > 0 THEN signed / flow ELSE 0 END AS order_flow_imbalance,
    CASE WHEN bid_qty + ask_qty > 0 THEN (bid_qty - ask_qty) / (bid_qty + ask_qty) ELSE 0 END AS book_imbalance, (last_ask - last_bid) / ((last_ask + last_bid) / 2) AS spread_pct, traded / (least(i, 720) * 3600) AS volume_per_second, i AS bars_seen, i >= 61 AND coalesce(v, 0) > 0 AS ready, ln(rolling_mean) AS log_mean FROM wf)"""
SQL_WN25 = f"WITH RECURSIVE {SQL_FEATURES} " + _sql_rounded(FEATURES, ("breakout", "bars_seen", "ready"), "ft")


@query(SQL_WN25)
def wn25_tick_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream's feature set over hourly bars, in batch."""
    return _features(ticks.stream_features(settled(_tick_bars(spark, sf_dir), "tick-bars"), HOUR))


def _streamed(rows: DataFrame) -> DataFrame:
    """A table landed in the shared folder, as a stream of its files."""
    landed = settled(rows, "landed")
    path = landed.inputFiles()[0].rsplit("/", 1)[0]
    return rows.sparkSession.readStream.schema(landed.schema).parquet(path)


@query(SQL_WN25)
def ss4_stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of bars, with state by symbol."""
    return _features(drain(stateful.stream_features(_streamed(_tick_bars(spark, sf_dir)), HOUR), "features"))


@query(f"WITH RECURSIVE {SQL_FEATURES}, cut AS (SELECT date_trunc('hour', min(ts) + (max(ts) - min(ts)) / 2) AS cut FROM tr) " + _sql_rounded(FEATURES, ("breakout", "bars_seen", "ready"), "ft, cut WHERE ts >= cut.cut"))
def ss5_seeded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the second half of the bars, from a stream whose state was seeded with the first half: no row of a seeded bar."""
    rows = settled(_tick_bars(spark, sf_dir), "tick-bars")
    ends = views.trades(spark, sf_dir).agg(F.unix_micros(F.min("ts")).alias("lo"), F.unix_micros(F.max("ts")).alias("hi")).first()
    cut = F.timestamp_micros(F.lit(((ends["lo"] or 0) + ((ends["hi"] or 0) - (ends["lo"] or 0)) // 2) // (HOUR * 1_000_000) * HOUR * 1_000_000))
    seed = settled(stateful.seed_state(rows.where(F.col("ts") < cut), HOUR), "seed")
    return _features(drain(stateful.stream_features(_streamed(rows.where(F.col("ts") >= cut)), HOUR, seed), "features"))


@query(f"""WITH {SQL_TRADES}, h AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, row(ts, seq)) AS o, max(price) AS hi, min(price) AS lo, arg_max(price, row(ts, seq)) AS c, sum(qty) AS v, coalesce(sum(qty) FILTER (NOT buyer_is_maker), 0) AS tb FROM tr GROUP BY 1, date_trunc('hour', ts)),
  g AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS b, arg_min(o, ts) AS open, max(hi) AS high, min(lo) AS low, arg_max(c, ts) AS close, sum(v) AS volume, sum(tb) AS taker_buy_volume, max(ts) AS last FROM h GROUP BY 1, 2)
  SELECT symbol, CAST(b AS VARCHAR) AS bar, round(open, 7) AS open, round(high, 7) AS high, round(low, 7) AS low, round(close, 7) AS close, round(volume, 7) AS volume, round(taker_buy_volume, 7) AS taker_buy_volume FROM g QUALIFY b < max(b) OVER (PARTITION BY symbol) OR last + INTERVAL 1 HOUR >= b + INTERVAL 4 HOUR""")
def ss3_stream_coarser_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of four hours from a stream of hourly ones; the last is among them only when its last hour has come."""
    hourly = _streamed(views.bars_1h(spark, sf_dir).drop("timeframe"))
    return _rounded(drain(stateful.coarser_bars(hourly, 4 * HOUR, HOUR), "coarse"), "open", "high", "low", "close", "volume", "taker_buy_volume")


INTENTS = ("enter", "stop_pct", "target_pct", "hold", "exit")
SQL_STOP = "least(greatest({m} * sigma * sqrt(24), 0.0015), 0.02)"


@query(f"""WITH RECURSIVE {SQL_FEATURES}, it AS (SELECT symbol, ts, 'momentum' AS kind, ready AND ema_fast > ema_slow AND momentum > 0 AND order_flow_imbalance >= 0.25 AND book_imbalance >= -0.5 AS enter, {SQL_STOP.format(m="1.5")} AS stop_pct, 2.5 * sigma * sqrt(24) AS target_pct, ema_fast < ema_slow AND order_flow_imbalance < 0 AS exit, spread_pct FROM ft
    UNION ALL SELECT symbol, ts, 'reversion', ready AND zscore <= -2 AND order_flow_imbalance >= -0.2 AND book_imbalance >= 0, {SQL_STOP.format(m="2.0")}, (rolling_mean - close) / close, zscore >= 0, spread_pct FROM ft)
  SELECT symbol, CAST(ts AS VARCHAR) AS bar, kind, enter, round(stop_pct, 7) AS stop_pct, round(target_pct, 7) AS target_pct, 48 AS hold, exit, target_pct >= 2 * (2 * 0.001 + spread_pct + 2 * 0.0005) AS pays FROM it""")
def pr9_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and exits of the stream's two strategies on every bar, and whether their targets clear the costs (PR-9 to PR-12)."""
    f = settled(ticks.stream_features(settled(_tick_bars(spark, sf_dir), "tick-bars"), HOUR), "features")
    both = ticks.momentum_intents(f, breakout=False).withColumn("kind", F.lit("momentum")).unionByName(ticks.reversion_intents(f).withColumn("kind", F.lit("reversion")))
    return _rounded(both.withColumn("pays", ticks.clears_costs(2.0, 0.001, 0.0005)), "kind", *INTENTS, "pays")


SQL_SHADOW = SQL_ROUGH + """, sg AS (SELECT DISTINCT CASE seq % 3 WHEN 0 THEN 'quick' ELSE 'slow' END AS strategy, symbol, ts, CASE seq % 3 WHEN 0 THEN 0.02 ELSE 0.2 END AS stop_pct, CASE seq % 3 WHEN 0 THEN 0.03 ELSE 0.6 END AS target_pct, CASE seq % 3 WHEN 0 THEN 600 ELSE 86400 END AS hold_s FROM tr WHERE seq % 4 = 0),
  en AS (SELECT s.strategy, s.symbol, s.ts AS sig, any_value(stop_pct) AS sp, any_value(target_pct) AS tp, any_value(hold_s) AS hs, min(row(q.ts, q.seq, q.ask)) AS e FROM sg AS s JOIN gq AS q ON q.symbol = s.symbol AND q.ts >= s.ts + INTERVAL 250 MILLISECOND GROUP BY 1, 2, 3),
  ep AS (SELECT strategy, symbol, sig, sp, tp, e[1] AS ets, e[2] AS eseq, e[3] AS price, e[1] + hs * INTERVAL 1 SECOND AS until FROM en),
  ht AS (SELECT strategy, p.symbol, sig, min(row(q.ts, q.seq, CASE WHEN q.bid <= price * (1 - sp) THEN 'stop' ELSE 'target' END)) AS h FROM ep AS p JOIN gq AS q ON q.symbol = p.symbol AND (q.ts > ets OR (q.ts = ets AND q.seq > eseq)) AND q.ts <= until AND (q.bid <= price * (1 - sp) OR q.bid >= price * (1 + tp)) GROUP BY 1, 2, 3),
  tg AS (SELECT p.*, coalesce(h[3], 'time') AS reason, coalesce(h[1], until) AS trig FROM ep AS p LEFT JOIN ht AS h ON h.strategy = p.strategy AND h.symbol = p.symbol AND h.sig = p.sig),
  ex AS (SELECT t.strategy, t.symbol, sig, min(row(q.ts, q.seq, q.bid)) AS x FROM tg AS t JOIN gq AS q ON q.symbol = t.symbol AND q.ts >= trig + INTERVAL 250 MILLISECOND GROUP BY 1, 2, 3),
  al AS (SELECT t.*, x[1] AS xts, x[3] AS xprice FROM tg AS t LEFT JOIN ex AS e ON e.strategy = t.strategy AND e.symbol = t.symbol AND e.sig = t.sig),
  rc AS (SELECT strategy, symbol, min(sig) AS sig FROM al GROUP BY 1, 2 UNION ALL SELECT a.strategy, a.symbol, min(b.sig) FROM rc AS r JOIN al AS a ON a.strategy = r.strategy AND a.symbol = r.symbol AND a.sig = r.sig JOIN al AS b ON b.strategy = a.strategy AND b.symbol = a.symbol AND b.sig > a.xts GROUP BY 1, 2)
  SELECT a.symbol, a.strategy, CAST(epoch_us(a.sig) AS BIGINT) AS signal_us, CAST(epoch_us(ets) AS BIGINT) AS entry_us, round(price, 7) AS entry_price, CAST(epoch_us(xts) AS BIGINT) AS exit_us, round(xprice, 7) AS exit_price, reason, round(xprice * (1 - 0.001) / (price * (1 + 0.001)) - 1, 7) AS net_return FROM al AS a JOIN rc AS r ON r.strategy = a.strategy AND r.symbol = a.symbol AND r.sig = a.sig WHERE xts IS NOT NULL"""


def _signals(t: DataFrame) -> DataFrame:
    """Signals of two made-up strategies at every fourth trade."""
    quick = F.col("seq") % 3 == 0
    pick = lambda a, b: F.when(quick, a).otherwise(b)
    return t.where("seq % 4 = 0").select(pick("quick", "slow").alias("strategy"), "symbol", "ts", pick(0.02, 0.2).alias("stop_pct"), pick(0.03, 0.6).alias("target_pct"), pick(600, 86400).alias("hold_s"))


def _shown_trades(rows: DataFrame) -> DataFrame:
    us = [F.unix_micros(f"{c}_ts").alias(f"{c}_us") for c in ("signal", "entry", "exit")]
    return rows.select("symbol", "strategy", us[0], us[1], F.round("entry_price", 7).alias("entry_price"), us[2], F.round("exit_price", 7).alias("exit_price"), "reason", F.round("net_return", 7).alias("net_return"))


@query(f"WITH RECURSIVE {SQL_SHADOW}")
def ex2_shadow_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of signals on rough quotes, one open at a time for a strategy and symbol."""
    t = views.trades(spark, sf_dir)
    return _shown_trades(ticks.shadow_trades(_signals(t).distinct(), views.rough_quotes(t).where("bid > 0 and ask >= bid")))


@query(f"WITH RECURSIVE {SQL_SHADOW}")
def ss8_stream_shadow_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from streams of quotes and signals; what is still open at their end is not among them."""
    t = views.trade_stream(spark, sf_dir)
    return _shown_trades(drain(stateful.shadow_trades(stateful.as_orders(views.rough_quotes(t).where("bid > 0 and ask >= bid"), _signals(t))), "shadow"))


@query("""WITH f AS (SELECT l_orderkey AS position, CASE WHEN l_linenumber % 2 = 1 THEN 'buy' ELSE 'sell' END AS side, CAST(l_extendedprice / l_quantity AS DOUBLE) AS price, CAST(l_quantity AS DOUBLE) AS shown, CAST(l_quantity * (l_linenumber % 3) AS DOUBLE) AS wanted, CAST(l_tax AS DOUBLE) AS fee FROM lineitem),
  p AS (SELECT *, CASE WHEN wanted > 0 THEN (least(shown / 2, wanted) * price + greatest(wanted - shown / 2, 0) * price * (1 + 0.002)) / wanted END AS paid FROM f), g AS (SELECT position, sum(paid * wanted) FILTER (side = 'buy') AS b, sum(paid * wanted) FILTER (side = 'sell') AS s, sum(fee) AS fees, sum(wanted) FILTER (side = 'buy') AS q FROM p GROUP BY 1)
  SELECT position, round(b, 7) AS paid, round(s, 7) AS got, round(fees, 7) AS fees, round(q, 7) AS quantity, round(s - b - fees, 7) AS pnl, round((s - b - fees) / nullif(b, 0), 6) AS net_return FROM g WHERE b IS NOT NULL AND s IS NOT NULL""")
def ex8_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of orders whose line items are fills, what exceeds half a line's size at a worse price (EX-7, EX-8)."""
    c = F.col
    f = views.table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("position"), F.when(c("l_linenumber") % 2 == 1, "buy").otherwise("sell").alias("side"), (c("l_extendedprice") / c("l_quantity")).cast("double").alias("_at"), c("l_quantity").cast("double").alias("_shown"), (c("l_quantity") * (c("l_linenumber") % 3)).cast("double").alias("quantity"), c("l_tax").cast("double").alias("fee"))
    rows = ticks.round_trips(f.withColumn("price", ticks.fill_price(c("_shown") / 2, c("quantity"), c("_at"), 0.002)))
    return rows.select("position", *(F.round(n, 7).alias(n) for n in ("paid", "got", "fees", "quantity", "pnl")), F.round("net_return", 6).alias("net_return"))


@query(f"""WITH RECURSIVE {SQL_TRADES}, e AS MATERIALIZED (SELECT symbol AS run_id, ts, seq, price * 10 AS equity, price AS buy_hold, max(price * 10) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS peak FROM tr), f AS MATERIALIZED (SELECT run_id, ts, arg_min(row(equity, buy_hold, peak), seq) AS r FROM e GROUP BY 1, 2),
  n AS MATERIALIZED (SELECT l.run_id, l.ts, r.ts AS then_ts FROM f AS l ASOF LEFT JOIN f AS r ON l.run_id = r.run_id AND l.ts + INTERVAL 6 HOUR <= r.ts), w AS (SELECT run_id, min(ts) AS ts FROM f GROUP BY 1 UNION ALL SELECT n.run_id, n.then_ts FROM w JOIN n ON n.run_id = w.run_id AND n.ts = w.ts WHERE n.then_ts IS NOT NULL)
  SELECT f.run_id, CAST(epoch_us(f.ts) AS BIGINT) AS at_us, round(r[1], 6) AS equity, round(r[2], 6) AS buy_hold, round(r[3], 6) AS peak FROM f JOIN w ON w.run_id = f.run_id AND w.ts = f.ts""")
def ss10_equity_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each symbol's worth at most every six hours of the stream, with the peak so far."""
    t = views.trade_stream(spark, sf_dir).select(F.col("symbol").alias("run_id"), "ts", "seq", (F.col("price") * 10).alias("equity"), F.col("price").alias("buy_hold"))
    got = drain(stateful.equity_samples(t, 6 * HOUR), "equity")
    return got.select("run_id", F.unix_micros("ts").alias("at_us"), *(F.round(c, 6).alias(c) for c in ("equity", "buy_hold", "peak")))


@query(f"WITH {SQL_TICK_BARS} " + _sql_rounded(BAR_COLUMNS, ("n_trades",), "cb"))
def ag2_rough_tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of rough quotes and trades with all their columns: highs and lows of mids, volume by side, and the last book, carried where only trades came."""
    t = views.trades(spark, sf_dir)
    return _rounded(bars.tick_bars(views.rough_quotes(t), t, "1 hour"), *BAR_COLUMNS)
