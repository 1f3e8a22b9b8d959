"""The rule catalogue as a table: one row a variant, its parameters in a map, one plan for all of them.

Entry and exit conditions are data (see conditions.py) on feature columns and on ``p``, the map of a variant's parameters. A comparison with a
missing value is false.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.operators.features import series
from marketlab.plans.conditions import Exit, Group, Spec, all_of, with_previous


@dataclass(frozen=True)
class Rule:
    name: str
    entry: Group
    params: dict[str, float]
    grid: dict[str, tuple[float, ...]]
    stop: float | str = "$stop"
    target: float | str | None = None
    hold: float | str = "$hold"
    leave: Group | None = None
    needs: frozenset[str] = field(default_factory=frozenset)

    def spec(self) -> Spec:
        """The rule as one object, as it is stored and hashed."""
        return Spec(self.name, self.name, self.entry, Exit(self.stop, self.target, None, None, self.hold, self.leave), dict(self.params))

    def variants(self) -> list[tuple[str, str, dict[str, float]]]:
        """(rule, variant, parameters): the grid's product, after the base where the base is none of its points."""
        points = [dict(zip(self.grid, values)) for values in itertools.product(*self.grid.values())]
        rows = [(f"{self.name}[{','.join(f'{k}={v}' for k, v in point.items())}]", self.params | point) for point in points]
        if self.params not in [p for _, p in rows]:
            rows.insert(0, (self.name, self.params))
        return [(self.name, name, {k: float(v) for k, v in p.items()}) for name, p in rows]


# Conditions, parameters and grids of the rules.
DAILY = (
    Rule("momentum", all_of(("momentum_20", ">", "$mom_th"), ("close", ">", "sma_200"), ("rsi", "<", "$rsi_max")), {"mom_th": 0.05, "rsi_max": 75, "stop_atr": 2.5}, {"mom_th": (0.03, 0.05, 0.08), "rsi_max": (70, 80), "stop_atr": (2.0, 3.0)}, stop="$stop_atr", target=4, hold=20),
    Rule("mean_reversion", all_of(("rsi", "<", "$rsi_th"), ("close", ">", "ema_200")), {"rsi_th": 30, "hold": 10}, {"rsi_th": (25, 30, 35), "hold": (5, 10, 15)}, stop=2, leave=all_of(("rsi", ">", 55))),
    Rule("breakout", all_of(("close", ">", "prev_high_20"), ("volume_ratio", ">", "$vol_th")), {"vol_th": 1.2, "stop_atr": 2.0}, {"vol_th": (1.0, 1.2, 1.5), "stop_atr": (1.5, 2.0, 3.0)}, stop="$stop_atr", target=3, hold=15),
    Rule("trend_following", all_of(("ema_20", "crosses_above", "ema_50"), ("close", ">", "sma_200")), {"stop_atr": 3.0, "hold": 60}, {"stop_atr": (2.0, 3.0, 4.0), "hold": (40, 60, 100)}, stop="$stop_atr", leave=all_of(("ema_20", "crosses_below", "ema_50"))),
    Rule("candlestick", all_of(("pat_bullish_engulfing", "==", 1), ("rsi", "<", "$rsi_th"), ("volume_ratio", ">", "$vol_th"), ("close", ">", "ema_200")), {"rsi_th": 40, "vol_th": 1.2}, {"rsi_th": (32, 40, 50), "vol_th": (1.0, 1.2, 1.5)}, stop=2, target=3, hold=10),
)
INTRADAY = (
    Rule("flow_breakout", all_of(("close", ">", "prev_high_20"), ("flow_imbalance_5", ">", "$flow"), ("close", ">", "ema_50")), {"flow": 0.2, "stop": 2.0, "target": 6.0, "hold": 60}, {"flow": (0.1, 0.3), "stop": (1.5, 3.0), "target": (4.0, 8.0), "hold": (30, 120)}, target="$target"),
    Rule("flow_momentum", all_of(("flow_imbalance_15", ">", "$flow"), ("ret_5", ">", "$mom"), ("close", ">", "ema_20")), {"flow": 0.2, "mom": 0.002, "stop": 2.0, "target": 6.0, "hold": 60}, {"flow": (0.15, 0.3), "mom": (0.001, 0.003), "stop": (2.0, 3.0), "target": (5.0, 10.0), "hold": (60, 240)}, target="$target"),
    Rule("rsi_flow_reversion", all_of(("rsi", "<", "$rsi"), ("flow_imbalance_5", ">", "$flow")), {"rsi": 25, "flow": 0.0, "stop": 3.0, "hold": 60, "rsi_exit": 55}, {"rsi": (20, 30), "flow": (-0.1, 0.1), "stop": (2.0, 4.0), "hold": (30, 120), "rsi_exit": (50, 65)}, leave=all_of(("rsi", ">", "$rsi_exit"))),
    Rule("bollinger_reversion", all_of(("bb_position", "<", "$bb"), ("dist_sma_200", ">", "$floor"), ("flow_imbalance_5", ">", -0.3)), {"bb": 0.0, "floor": -0.02, "stop": 3.0, "hold": 60}, {"bb": (-0.1, 0.05), "floor": (-0.03, -0.01), "stop": (2.0, 4.0), "hold": (30, 120)}, leave=all_of(("bb_position", ">", 0.5))),
    Rule("vwap_reversion", all_of(("vwap_dev", "<", "$dev"), ("flow_imbalance_5", ">", 0)), {"dev": -0.004, "stop": 3.0, "hold": 60}, {"dev": (-0.003, -0.006, -0.01), "stop": (2.0, 4.0), "hold": (30, 120)}, leave=all_of(("vwap_dev", ">", 0))),
    Rule("squeeze_breakout", all_of(("atr_pct", "<", "$atr_max"), ("close", ">", "prev_high_20"), ("volume_ratio", ">", "$vr")), {"atr_max": 0.001, "vr": 2.0, "stop": 2.0, "target": 8.0, "hold": 120}, {"atr_max": (0.0007, 0.0015), "vr": (1.5, 3.0), "stop": (1.5, 3.0), "target": (6.0, 12.0), "hold": (60, 240)}, target="$target"),
    Rule("trend_pullback", all_of(("close", ">", "ema_200"), ("trend_strength", ">", "$trend"), ("dist_ema_20", "<", "$pull"), ("flow_imbalance_5", ">", 0)), {"trend": 2.0, "pull": -0.001, "stop": 2.5, "target": 8.0, "hold": 120}, {"trend": (1.0, 3.0), "pull": (-0.0005, -0.002), "stop": (2.0, 3.5), "target": (6.0, 12.0), "hold": (60, 240)}, target="$target"),
)
SWING = (
    Rule("xs_momentum", all_of(("xs_rank_ret_20", ">", "$rank"), ("close", ">", "ema_50")), {"rank": 0.8, "stop": 3.0, "hold": 20}, {"rank": (0.7, 0.85), "stop": (2.0, 3.0), "hold": (10, 40)}, leave=all_of(("xs_rank_ret_20", "<", 0.5))),
    Rule("xs_momentum_long", all_of(("xs_rank_ret_60", ">", "$rank"), ("ema_50", ">", "ema_200")), {"rank": 0.8, "stop": 3.0, "hold": 40}, {"rank": (0.7, 0.85), "stop": (2.5, 4.0), "hold": (20, 80)}, leave=all_of(("xs_rank_ret_60", "<", 0.5))),
    Rule("xs_reversal", all_of(("xs_rank_ret_5", "<", "$rank"), ("close", ">", "ema_200")), {"rank": 0.15, "stop": 3.0, "hold": 10}, {"rank": (0.1, 0.25), "stop": (2.0, 3.0), "hold": (5, 15)}, leave=all_of(("xs_rank_ret_5", ">", 0.6))),
    Rule("relative_strength", all_of(("xs_rel_ret_20", ">", "$rel"), ("xs_breadth", ">", "$breadth")), {"rel": 0.02, "breadth": 0.6, "stop": 3.0, "hold": 40}, {"rel": (0.01, 0.03), "breadth": (0.5, 0.7), "stop": (2.0, 3.0), "hold": (20, 60)}, leave=all_of(("xs_rel_ret_20", "<", 0))),
    Rule("trend_follow", all_of(("ema_50", ">", "ema_200"), ("close", ">", "ema_50"), ("momentum_20", ">", "$mom")), {"mom": 0.0, "stop": 3.0, "hold": 100}, {"mom": (0.0, 0.02), "stop": (2.0, 3.5), "hold": (50, 150)}, leave=all_of(("close", "<", "ema_50"))),
    Rule("breakout_volume", all_of(("close", ">", "prev_high_20"), ("volume_ratio", ">", "$vr")), {"vr": 2.0, "stop": 2.0, "target": 6.0, "hold": 40}, {"vr": (1.5, 2.5), "stop": (1.5, 3.0), "target": (4.0, 8.0), "hold": (20, 60)}, target="$target"),
    Rule("breadth_dip", all_of(("xs_breadth", "<", "$breadth"), ("close", ">", "ema_200"), ("rsi", "<", 35)), {"breadth": 0.35, "stop": 3.0, "hold": 20}, {"breadth": (0.3, 0.4), "stop": (2.5, 4.0), "hold": (10, 40)}, leave=all_of(("rsi", ">", 55))),
    Rule("streak_reversion", all_of(("down_streak", ">=", "$n"), ("close", ">", "sma_200")), {"n": 3, "stop": 2.5, "hold": 5}, {"n": (2, 3, 4), "hold": (3, 6)}, leave=all_of(("rsi_2", ">", 70))),
    Rule("rsi2_reversion", all_of(("rsi_2", "<", "$th"), ("close", ">", "sma_200")), {"th": 10, "stop": 2.5, "hold": 5}, {"th": (5, 10, 15)}, leave=all_of(("rsi_2", ">", 70))),
    Rule("ibs_reversion", all_of(("close_position", "<", "$ibs"), ("close", ">", "sma_200")), {"ibs": 0.2, "stop": 2.5, "hold": 3}, {"ibs": (0.1, 0.2), "hold": (1, 3)}, leave=all_of(("close_position", ">", 0.7)), needs=frozenset({"daily"})),
    Rule("candle_reversal", all_of(("rsi", "<", "$rsi"), ("close", ">", "ema_200"), any_of=[("pat_bullish_engulfing", "==", 1), ("pat_hammer", "==", 1)]), {"rsi": 40}, {"rsi": (35, 45)}, stop=2, target=3, hold=10),
    Rule("near_52w_high", all_of(("dist_high_252", ">", "$near"), ("close", ">", "sma_200")), {"near": -0.03, "stop": 3.0, "hold": 126}, {"near": (-0.02, -0.05), "hold": (60, 126)}, leave=all_of(("dist_high_252", "<", -0.1)), needs=frozenset({"daily"})),
    Rule("turn_of_month", all_of(("days_to_month_end", "<=", "$pre")), {"pre": 2}, {"pre": (2, 4)}, stop=3, hold=8, leave=all_of(("day_of_month", ">=", 3), ("day_of_month", "<=", 20)), needs=frozenset({"daily", "equity"})),
    Rule("news_drift", all_of(("news_ratio", ">", "$k"), ("ret_1", ">", 0.02), ("volume_ratio", ">", 1.5)), {"k": 2.0, "stop": 2.5, "hold": 10}, {"k": (2.0, 3.0), "hold": (5, 20)}, needs=frozenset({"news"})),
    Rule("quiet_drop_reversal", all_of(("ret_1", "<", "$drop"), ("news_ratio", "<", 1), ("close", ">", "sma_200")), {"drop": -0.03, "stop": 2.5, "hold": 5}, {"drop": (-0.02, -0.04), "hold": (3, 6)}, leave=all_of(("rsi_2", ">", 70)), needs=frozenset({"news"})),
    Rule("earnings_gap_drift", all_of(("news_earnings_1d", ">=", 1), ("gap", ">", "$gap"), ("volume_ratio", ">", 2)), {"gap": 0.03, "hold": 20}, {"gap": (0.02, 0.05), "hold": (20, 40)}, stop=3, needs=frozenset({"news"})),
)


def applicable(rules: tuple[Rule, ...], *has: str) -> tuple[Rule, ...]:
    """Rules whose needs (daily, equity, news) the bars meet."""
    return tuple(r for r in rules if r.needs <= set(has))


def runnable(rules: tuple[Rule, ...], columns: list[str]) -> tuple[Rule, ...]:
    """Rules all of whose features are there; the others are skipped."""
    return tuple(r for r in rules if r.spec().features() <= set(columns))


def _by_rule(rules: tuple[Rule, ...], value) -> Column:
    """A branch for each rule; null for others."""
    out = F.lit(None)
    for r in rules:
        out = F.when(F.col("rule") == r.name, value(r)).otherwise(out)
    return out


def _number(x: float | str | None) -> Column:
    return F.col("p")[x[1:]] if isinstance(x, str) else F.lit(x).cast("double")


def variant_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """rule, variant, p, stop_atr, target_atr, hold: a few hundred rows, whatever the data."""
    rows = spark.createDataFrame([v for r in rules for v in r.variants()], "rule string, variant string, p map<string,double>")
    return rows.withColumns({"stop_atr": _by_rule(rules, lambda r: _number(r.stop)).cast("double"), "target_atr": _by_rule(rules, lambda r: _number(r.target)).cast("double"), "hold": _by_rule(rules, lambda r: _number(r.hold)).cast("int")})


def conditions(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Entry and exit of whatever rule a row is of."""
    return tuple(F.coalesce(_by_rule(rules, part), F.lit(False)) for part in (lambda r: r.entry.column(), lambda r: r.leave.column() if r.leave else F.lit(False)))


def prepared(bars: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """bars with what the rules' crossings need of the row before."""
    return with_previous(bars, [g for r in rules for g in (r.entry, r.leave)])


def crosses(left: str, right: str, *more: str) -> tuple[Column, Column]:
    """left crosses above, and below, right against the row before; more: further partition columns, as a fold."""
    gap = F.col(left) - F.col(right)
    before = F.lag(gap).over(series().partitionBy("symbol", *more))
    return F.coalesce((before <= 0) & (gap > 0), F.lit(False)), F.coalesce((before >= 0) & (gap < 0), F.lit(False))
