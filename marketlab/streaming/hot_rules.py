"""Rules that come and go while a stream runs: a log of changes, decisions bar by bar, and each rule's trades.

Three steps, each restartable by itself:

1. with_before(): a stream of completed bars with features, each bar with the values before that crossings look at.
2. decided(): for every micro-batch the log is read anew, its rules are compiled to Columns, and bars are written with the rules that enter or leave on them.
   A rule acts on bars that end at or after it was added and before it was removed, by the bars' own time: a repeated micro-batch decides the same,
   also when the log has grown, as long as changes are not dated back.
3. rule_trades(): each rule's one open trade of a symbol. A removed rule takes no entries, and what it holds is closed by its own exits.

A rule on the symbol ``*`` is one rule with one id on every symbol. The log is configuration, not data: a few rules a strategy desk keeps.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from marketlab.plans.conditions import BEFORE, Spec, exit_of, group
from marketlab.streaming.stateful import Keyed, _with_ts, _with_us, keyed

LOG = "strategy string, symbol string, spec string, action string, ts timestamp, seq long"
#: More rules than this at once would make a plan too wide to compile; the log is refused then, not cut.
MOST_RULES = 500


def spec_of(data: dict) -> Spec:
    """A rule from the object that Spec.data() gives."""
    return Spec(data["name"], data["family"], group(data["entry"]), exit_of(data["exit"]), dict(data.get("params") or {}), int(data.get("version", 1)), data.get("description") or "")


# --- the log of changes


def rule_spans(log: DataFrame) -> DataFrame:
    """strategy, symbol, spec, from_us, until_us (null: still there) of every time a strategy was active.

    Adding one that is there, or removing one that is not, changes nothing; one that comes back has a second span, with the spec it comes back with.
    """
    by = W.partitionBy("strategy").orderBy("ts", "seq")
    rows = log.where(F.col("action").isin("add", "remove") & F.col("strategy").isNotNull() & F.col("ts").isNotNull())
    changed = rows.withColumn("_was", F.lag("action").over(by)).where("action <> coalesce(_was, 'remove')")
    spans = changed.withColumn("until_us", F.unix_micros(F.lead("ts").over(by))).where("action = 'add'")
    return spans.select("strategy", "symbol", "spec", F.unix_micros("ts").alias("from_us"), "until_us")


def rule_changes(spans: DataFrame, before_us: int, now_us: int, open_trades: DataFrame | None = None) -> DataFrame:
    """strategy, change: what became of the strategies between two times: added, kept, removed, or retiring (removed, but a trade of open_trades (strategy) runs on)."""
    at = lambda us: F.coalesce(F.max((F.col("from_us") <= us) & (F.col("until_us").isNull() | (F.col("until_us") > us))), F.lit(False))
    seen = spans.groupBy("strategy").agg(at(before_us).alias("was"), at(now_us).alias("is")).where("was or is")
    holds = F.lit(False)
    if open_trades is not None:
        seen = seen.join(open_trades.select("strategy", F.lit(True).alias("_holds")).distinct(), "strategy", "left")
        holds = F.coalesce("_holds", F.lit(False))
    return seen.select("strategy", F.when(~F.col("was"), "added").when(F.col("is"), "kept").when(holds, "retiring").otherwise("removed").alias("change"))


# --- bars with the values before


class Before(Keyed):
    """Gives each bar the named values of the bar before it, over the borders of micro-batches."""

    def __init__(self, names: list[str]):
        self.names = names
        self.state_schema = ", ".join(["last_us long", "late long", *(f"v{k} double" for k in range(len(names)))])

    def step(self, rows, state):
        state = state or {"last_us": None, "late": 0, **{f"v{k}": None for k in range(len(self.names))}}
        us = rows["us"].to_numpy()
        fresh = us > (-(1 << 62) if state["last_us"] is None else state["last_us"])
        fresh[1:] &= np.diff(us) > 0
        state["late"] += int((~fresh).sum())
        rows = rows[fresh].drop(columns="symbol").reset_index(drop=True)
        if not len(rows):
            return pd.DataFrame(), state
        state["last_us"] = int(rows["us"].iloc[-1])
        for k, name in enumerate(self.names):
            values = rows[name].to_numpy(float)
            rows[f"{BEFORE}{name}"] = np.concatenate([[np.nan if state[f"v{k}"] is None else state[f"v{k}"]], values[:-1]])
            state[f"v{k}"] = float(values[-1])
        rows["late"] = state["late"]
        return rows, state


def _numbers(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "ts", *(F.col(c).cast("double").alias(c) for c in bars.columns if c not in ("symbol", "ts")))


def with_before(bars: DataFrame, names: list[str], history: DataFrame | None = None) -> DataFrame:
    """Completed bars (symbol, ts, numeric columns) with the named values before and ``late``; repeated and older bars are left out.

    history: bars before the stream. They give the first bar its values before; no row comes out for them, so no rule acts on them.
    """
    rows, names = _with_us(_numbers(bars)), sorted(set(names))
    schema = ", ".join(["us long", *(f"`{c}` double" for c in rows.columns if c not in ("symbol", "us")), *(f"`{BEFORE}{n}` double" for n in names), "late long"])
    # The order of columns that go in is the order that come out.
    rows = rows.select("symbol", "us", *(c for c in rows.columns if c not in ("symbol", "us")))
    seed = None
    if history is not None:
        past = _with_us(_numbers(history))
        seed = past.groupBy("symbol").agg(F.max("us").alias("last_us"), F.lit(0).cast("long").alias("late"), *(F.max_by(F.struct(n), "us")[n].alias(f"v{k}") for k, n in enumerate(names)))
    return _with_ts(keyed(rows, Before(names), schema, seed))


# --- decisions


def decide(bars: DataFrame, spans: DataFrame, seconds: int) -> DataFrame:
    """bars with ``entries`` (strategy, stop and target as distances in price and as fractions, hold in bars) and ``exits`` (strategies whose exit signal holds).

    bars carry the values before. A rule on features that are not there, or without a measurable stop, never enters.
    """
    found = spans.limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules at once")
    end, have = F.unix_micros("ts") + F.lit(seconds * 1_000_000), set(bars.columns)
    number = lambda x: F.lit(None if x is None else float(x)).cast("double")
    entries, exits = [], []
    for r in sorted(found, key=lambda r: (r["strategy"], r["from_us"])):
        spec = spec_of(json.loads(r["spec"])).render()
        if not spec.features() <= have:
            continue
        ex, atr = spec.exit, F.nanvl("atr", F.lit(None).cast("double")) if "atr" in have else F.lit(None).cast("double")
        mine = (F.lit(True) if r["symbol"] == "*" else F.col("symbol") == r["symbol"]) & (end >= r["from_us"])
        stop, target = number(ex.stop_atr_mult) * atr, number(ex.target_atr_mult) * atr
        enters = mine & (F.lit(True) if r["until_us"] is None else end < r["until_us"]) & spec.entry.column() & (stop.isNotNull() | number(ex.stop_pct).isNotNull())
        hold = F.lit(None if ex.max_holding_bars is None else int(ex.max_holding_bars)).cast("long")
        entries.append(F.when(enters, F.struct(F.lit(r["strategy"]).alias("strategy"), stop.alias("stop"), number(ex.stop_pct).alias("stop_pct"), target.alias("target"), number(ex.target_pct).alias("target_pct"), hold.alias("hold"))))
        if ex.exit_signal:
            exits.append(F.when(mine & ex.exit_signal.column(), F.lit(r["strategy"])))
    kept = lambda some, kind: F.filter(F.array(*some), lambda x: x.isNotNull()).cast(kind) if some else F.array().cast(kind)
    entry = "array<struct<strategy:string,stop:double,stop_pct:double,target:double,target_pct:double,hold:bigint>>"
    return bars.withColumns({"entries": kept(entries, entry), "exits": kept(exits, "array<string>")}).select("symbol", "ts", "open", "high", "low", "close", "entries", "exits")


DECIDED = "symbol string, ts timestamp, open double, high double, low double, close double, entries array<struct<strategy:string,stop:double,stop_pct:double,target:double,target_pct:double,hold:bigint>>, exits array<string>, batch long"


def decided(bars: DataFrame, log: Callable[[SparkSession], DataFrame], seconds: int, path: str, **trigger) -> StreamingQuery:
    """Run the stream of with_before() bars into path/rows, a partition a micro-batch. log is called in every micro-batch and gives the log as it is then."""

    def land(batch: DataFrame, number: int) -> None:
        rows = decide(batch, rule_spans(log(batch.sparkSession)), seconds)
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/rows")

    return bars.writeStream.foreachBatch(land).option("checkpointLocation", f"{path}/state").trigger(**(trigger or {"availableNow": True})).start()


def decided_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """What decided() wrote, as a stream."""
    source = spark.readStream.schema(DECIDED)
    return (source.option("maxFilesPerTrigger", files) if files else source).parquet(f"{path}/rows").drop("batch")


# --- trades


class RuleTrades(Keyed):
    """A signal on a bar enters at the next bar's open; the trade ends on an exit signal of the bar before, its hold, its stop or its target, in this order.

    While a strategy's trade runs, its further signals on that symbol are passed over; the bar that ends a trade may signal the next.
    """

    state_schema = "last_us long, late long, strategy array<string>, signal_us array<long>, entry_us array<long>, entry_price array<double>, stop array<double>, stop_pct array<double>, target array<double>, target_pct array<double>, hold array<long>, held array<long>, leave array<boolean>"
    OPEN = ("strategy", "signal_us", "entry_us", "entry_price", "stop", "stop_pct", "target", "target_pct", "hold", "held", "leave")

    @staticmethod
    def _enter(t: dict, us: int, price: float) -> None:
        """Turn the distances of a signal into prices: the nearest stop and the nearest target of those it has."""
        near = lambda flat, part, sign: [price + sign * d for d in (flat, None if part is None else price * part) if d is not None]
        stops, targets = near(t["stop"], t["stop_pct"], -1), near(t["target"], t["target_pct"], 1)
        t |= {"entry_us": us, "entry_price": price, "stop": max(stops), "target": min(targets, default=None), "stop_pct": None, "target_pct": None, "held": 0}

    @staticmethod
    def _end(t: dict, bar) -> tuple[str, float] | None:
        """Why, and at what price, an entered trade ends on this bar."""
        later = t["held"] > 0
        if later and t["leave"]:
            return "signal", bar.open
        if later and t["hold"] is not None and t["held"] >= t["hold"]:
            return "max_holding", bar.open
        if bar.low <= t["stop"]:
            return "stop", min(bar.open, t["stop"]) if later else t["stop"]
        if t["target"] is not None and bar.high >= t["target"]:
            return "target", max(bar.open, t["target"]) if later else t["target"]
        return None

    def step(self, rows, state):
        state = state or {"last_us": None, "late": 0, **{n: [] for n in self.OPEN}}
        last, late, done = -(1 << 62) if state["last_us"] is None else state["last_us"], state["late"], []
        running = {s: dict(zip(self.OPEN, values)) for s, values in zip(state["strategy"], zip(*(state[n] for n in self.OPEN)))}
        for bar in rows.itertuples(index=False):
            if bar.us <= last:
                late += 1
                continue
            last, leaving = int(bar.us), set(bar.exits)
            for s, t in list(running.items()):
                if t["entry_us"] is None:
                    self._enter(t, last, float(bar.open))
                if end := self._end(t, bar):
                    done.append({"strategy": s, "signal_us": t["signal_us"], "entry_us": t["entry_us"], "entry_price": t["entry_price"], "exit_us": last, "exit_price": float(end[1]), "reason": end[0], "late": late})
                    del running[s]
                else:
                    t |= {"held": t["held"] + 1, "leave": s in leaving}
            for e in bar.entries:
                e = {k: None if v is None or v != v else v for k, v in (e if isinstance(e, dict) else e.asDict()).items()}
                running.setdefault(e["strategy"], dict.fromkeys(self.OPEN) | e | {"signal_us": last, "held": 0, "leave": False})
        out = pd.DataFrame(done, columns=["strategy", "signal_us", "entry_us", "entry_price", "exit_us", "exit_price", "reason", "late"])
        return out, {n: [t[n] for t in running.values()] for n in self.OPEN} | {"last_us": None if last == -(1 << 62) else last, "late": late}


RULE_TRADES = "strategy string, signal_us long, entry_us long, entry_price double, exit_us long, exit_price double, reason string, late long"


def rule_trades(decisions: DataFrame) -> DataFrame:
    """Finished trades of a stream of decided bars: symbol, strategy, times and prices of entry and exit, reason, and late rows so far."""
    found = keyed(_with_us(decisions), RuleTrades(), RULE_TRADES)
    times = {f"{c}_ts": F.timestamp_micros(f"{c}_us") for c in ("signal", "entry", "exit")}
    return found.withColumns(times).select("symbol", "strategy", "signal_ts", "entry_ts", "entry_price", "exit_ts", "exit_price", "reason", "late")


def with_retirement(trades: DataFrame, spans: DataFrame, seconds: int) -> DataFrame:
    """Adds ``retired``: the trade ended at or after the removal of the rule that entered it."""
    signal_end = F.unix_micros("signal_ts") + F.lit(seconds * 1_000_000)
    own = F.broadcast(spans.select("strategy", "from_us", "until_us"))
    inside = (trades["strategy"] == own["strategy"]) & (signal_end >= own["from_us"]) & (own["until_us"].isNull() | (signal_end < own["until_us"]))
    return trades.join(own, inside, "left").select(trades["*"], F.coalesce(F.unix_micros("exit_ts") >= F.col("until_us"), F.lit(False)).alias("retired"))
