"""What comes from feeds and landed payloads: news features, JSON bars, name suffixes, and what learning waits for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlab.functions.columns import headline_kind
from marketlab.operators.joins import range_counts

#: A headline counts this many seconds after it came; one on more symbols than this counts for none.
NEWS_LAG_S, MAX_SYMBOLS, BASELINE_DAYS = 300, 5, 20

BAR_JSON = "bars map<string,array<struct<t:string,o:double,h:double,l:double,c:double,v:double>>>"


def news_features(bars: DataFrame, headlines: DataFrame, covered: DataFrame, seconds: int) -> DataFrame:
    """Adds ``news_1d``, ``news_ratio`` (against the 20 days before) and ``news_earnings_1d`` as known when a bar of ``seconds`` ends.

    headlines: id, created_at, headline, symbols. covered: one row, covered_from and covered_until; bars whose 21 days are not covered get nulls.
    """
    once = headlines.dropDuplicates(["id"]).where(F.size("symbols").between(1, MAX_SYMBOLS))
    news = once.select(F.explode(F.array_distinct(F.transform("symbols", F.upper))).alias("_symbol"), F.col("created_at").alias("ts"), (headline_kind(F.col("headline")) == "earnings").alias("_e"))
    cut = F.timestamp_seconds(F.unix_timestamp("ts") + seconds - NEWS_LAG_S)
    asked = bars.select(F.upper("symbol").alias("_symbol"), cut.alias("ts")).distinct()
    longest = BASELINE_DAYS + 1
    counts = range_counts(asked, news, (1, longest), "_symbol")
    earnings = range_counts(asked, news.where("_e"), (1,), "_symbol").withColumnRenamed("n_1d", "_earnings")
    known = asked.join(counts, ["_symbol", "ts"]).join(earnings, ["_symbol", "ts"]).crossJoin(F.broadcast(covered))
    inside = (F.col("ts") - F.expr(f"interval {longest} days") >= F.col("covered_from")) & (F.col("ts") <= F.col("covered_until"))
    day = F.col("n_1d").cast("double")
    values = {"news_1d": day, "news_ratio": day / ((F.col(f"n_{longest}d") - F.col("n_1d")) / BASELINE_DAYS + 1), "news_earnings_1d": F.col("_earnings").cast("double")}
    found = known.select("_symbol", F.col("ts").alias("_cut"), *(F.when(inside, v).alias(n) for n, v in values.items()))
    return bars.withColumns({"_symbol": F.upper("symbol"), "_cut": cut}).join(found, ["_symbol", "_cut"], "left").drop("_symbol", "_cut")


def bars_from_json(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Bars of payloads that map a symbol to its list of bars; bars without a time or a positive price are dropped."""
    rows = payloads.select(F.explode(F.from_json(column, BAR_JSON)["bars"]).alias("symbol", "_rows")).select("symbol", F.inline("_rows"))
    rows = rows.select("symbol", F.try_to_timestamp("t").alias("ts"), *(F.col(x).alias(n) for x, n in zip("ohlcv", ("open", "high", "low", "close", "volume"))))
    return rows.where("ts is not null and least(open, high, low, close) > 0 and open is not null and close is not null")


def known_suffix(name: Column, suffixes: tuple[str, ...]) -> Column:
    """The first of the suffixes that a name ends with, else null."""
    return F.coalesce(*(F.when(name.endswith(s), s) for s in suffixes))


def needed_examples(last_n: Column, least: int = 60) -> Column:
    """Examples before the next attempt: ``least``, or half as many again as the last attempt had."""
    return F.when(last_n > 0, F.greatest(F.lit(least), F.ceil(last_n * 1.5))).otherwise(least).cast("long")
