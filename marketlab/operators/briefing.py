"""Briefings that cite headlines: what the headlines they were shown support stays, and the rest is told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marketlab.functions.columns import headline_kind
from marketlab.sources.payloads import _object, _strip

MAX_EVENTS, MAX_WATCH = 8, 15
NEW_YORK = "America/New_York"


def _list(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def _upper(text: Column) -> Column:
    return F.transform(F.filter(_list(text), lambda x: x.isNotNull()), F.upper)


def checked_events(briefings: DataFrame, shown: DataFrame, kinds: list[str]) -> DataFrame:
    """briefing, at, place, headline_ids, symbols, kind, importance, why, unknown_ids, invented, problem of every event that a briefing lists.

    briefings: briefing, payload ({market_summary, events, watchlist}). shown: briefing, id, headline, symbols: what each was given. An event keeps the cited headlines that are
    there and those of its symbols that they name; without any it has a problem, as has one that is no object, or whose briefing has no summary. Others are placed by importance, then as listed.
    """
    parsed = briefings.withColumn("_b", _object(F.col("payload"))).select("briefing", F.coalesce(_strip(F.col("_b")["market_summary"]), F.lit("")).alias("_summary"), F.posexplode(_list(F.col("_b")["events"])).alias("at", "_e"))
    e = F.col("_d")
    events = parsed.withColumn("_d", _object(F.col("_e"))).select(
        "briefing", "at", "_summary", e.isNull().alias("_broken"), _list(e["headline_ids"]).alias("_cited"), _upper(e["symbols"]).alias("_asked"), e["type"].alias("_type"), F.coalesce(e["importance"].try_cast("int"), F.lit(3)).alias("_i"), F.substring(_strip(F.coalesce(e["why_it_matters"], F.lit(""))), 1, 400).alias("why")
    )
    cites = events.select("briefing", "at", F.posexplode("_cited").alias("_p", "_text")).withColumn("id", F.trim("_text").try_cast("long"))
    given = shown.dropDuplicates(["briefing", "id"]).select("briefing", "id", F.transform("symbols", F.upper).alias("_s"), headline_kind(F.col("headline")).alias("_k"))
    found = cites.join(given, ["briefing", "id"], "left")
    real = F.col("_k").isNotNull()
    known = found.groupBy("briefing", "at").agg(
        F.transform(F.array_sort(F.collect_list(F.when(real, F.struct("_p", "id")))), lambda x: x["id"]).alias("headline_ids"), F.array_distinct(F.flatten(F.collect_list("_s"))).alias("_allowed"), F.min_by("_k", F.when(real, F.col("_p"))).alias("_first"), F.count(F.when(~real, 1)).alias("unknown_ids")
    )
    none = F.array().cast("array<string>")
    out = events.join(known, ["briefing", "at"], "left").withColumns({"headline_ids": F.coalesce("headline_ids", F.array().cast("array<bigint>")), "_allowed": F.coalesce("_allowed", none), "unknown_ids": F.coalesce("unknown_ids", F.lit(0))})
    bad = F.when(F.col("_summary") == "", "no summary").when(F.col("_broken"), "no event").when(F.size("headline_ids") == 0, "no real headline")
    kind = F.when(F.col("_type").isin(kinds), F.col("_type")).otherwise(F.col("_first"))
    out = out.withColumns({"problem": bad, "symbols": F.array_intersect("_asked", "_allowed"), "invented": F.size(F.array_except("_asked", "_allowed")), "kind": kind, "importance": F.greatest(F.lit(1), F.least(F.lit(5), F.when(F.col("_i") == 0, 3).otherwise(F.col("_i"))))})
    place = F.when(F.col("problem").isNull(), F.row_number().over(W.partitionBy("briefing", F.col("problem").isNull()).orderBy(F.desc("importance"), "at")))
    return out.withColumn("place", place).select("briefing", "at", "place", "headline_ids", "symbols", "kind", "importance", "why", "unknown_ids", "invented", "problem")


def kept_events(checked: DataFrame) -> DataFrame:
    """The most important events of each briefing."""
    return checked.where(F.col("place") <= MAX_EVENTS)


def watchlists(briefings: DataFrame, shown: DataFrame) -> DataFrame:
    """briefing, watchlist (its symbols that any headline shown names, in order, at most fifteen), invented (how many others)."""
    every = shown.groupBy("briefing").agg(F.array_distinct(F.flatten(F.collect_list(F.transform("symbols", F.upper)))).alias("_every"))
    asked = briefings.select("briefing", _upper(_object(F.col("payload"))["watchlist"]).alias("_asked")).join(every, "briefing", "left")
    known = F.coalesce("_every", F.array().cast("array<string>"))
    return asked.select("briefing", F.slice(F.array_intersect("_asked", known), 1, MAX_WATCH).alias("watchlist"), F.size(F.array_except("_asked", known)).alias("invented"))


def one_a_day(briefings: DataFrame) -> DataFrame:
    """The first briefing (made_at, then briefing) of each date in New York that has a summary, with ``date``."""
    fit = briefings.where(F.coalesce(_strip(_object(F.col("payload"))["market_summary"]), F.lit("")) != "")
    dated = fit.withColumn("date", F.to_date(F.from_utc_timestamp(F.to_utc_timestamp("made_at", F.current_timezone()), NEW_YORK)))
    first = dated.groupBy("date").agg(F.min_by(F.struct(*dated.columns), F.struct("made_at", "briefing")).alias("_r"))
    return first.select("_r.*")


def cited_headlines(events: DataFrame, shown: DataFrame) -> DataFrame:
    """The rows of shown that events cite, each once a briefing."""
    cites = events.select("briefing", F.explode("headline_ids").alias("id")).distinct()
    return shown.dropDuplicates(["briefing", "id"]).join(cites, ["briefing", "id"], "left_semi")
