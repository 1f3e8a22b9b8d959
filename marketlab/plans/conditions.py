"""Rules as data: nested conditions on features, read from plain objects (as JSON has them) and compiled to Columns.

A condition compares a feature with a number, another feature, or a parameter (``$name``, looked up in the map ``p`` of a variant's
parameters). A group holds when all of ``all_of`` and at least one of ``any_of`` hold (either may be empty, not both), and is turned round last where
``negate`` is set. A missing value makes its condition false before any negation.

Crossings look at the row before. Its values come with the row, as ``_before_<feature>``, so that conditions stay free of window functions and may be used in
filters and after joins: with_previous() adds them.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import operator
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}
CROSS = ("crosses_above", "crosses_below")
BEFORE = "_before_"


def _is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _value(ref, prefix: str = "") -> Column:
    if _is_number(ref):
        return F.lit(float(ref))
    return F.col("p")[ref[1:]] if ref.startswith("$") else F.col(f"`{prefix}{ref}`").cast("double")


def _known(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


@dataclass(frozen=True)
class Condition:
    left: str
    op: str
    right: float | str

    def __post_init__(self):
        if self.op not in COMPARE and self.op not in CROSS:
            raise ValueError(f"unknown operator {self.op!r}")
        if not isinstance(self.left, str) or self.left.startswith("$") or not (_is_number(self.right) or isinstance(self.right, str)):
            raise ValueError("a condition compares a feature with a number, a feature or a $parameter")

    def column(self) -> Column:
        left, right = _value(self.left), _value(self.right)
        if self.op in COMPARE:
            test = COMPARE[self.op](left, right)
        else:
            # Numbers and parameters stay as they are from row to row.
            gap, before = left - right, _value(self.left, BEFORE) - _value(self.right, BEFORE if self._right_is_feature else "")
            above = self.op == "crosses_above"
            test = ((before <= 0) & (gap > 0) if above else (before >= 0) & (gap < 0)) & _known(before)
        return F.coalesce(test, F.lit(False)) & _known(left) & F.coalesce(_known(right), F.lit(False))

    @property
    def _right_is_feature(self) -> bool:
        return isinstance(self.right, str) and not self.right.startswith("$")

    def features(self) -> set[str]:
        return {self.left} | ({self.right} if self._right_is_feature else set())

    def crossing(self) -> set[str]:
        return self.features() if self.op in CROSS else set()

    def parameters(self) -> set[str]:
        return {self.right[1:]} if isinstance(self.right, str) and self.right.startswith("$") else set()

    def data(self) -> dict:
        return {"left": self.left, "op": self.op, "right": self.right}


@dataclass(frozen=True)
class Group:
    all_of: tuple[Condition | Group, ...] = ()
    any_of: tuple[Condition | Group, ...] = ()
    negate: bool = False

    def __post_init__(self):
        if not self.all_of and not self.any_of:
            raise ValueError("a group needs at least one condition")

    @property
    def parts(self) -> tuple[Condition | Group, ...]:
        return (*self.all_of, *self.any_of)

    def column(self) -> Column:
        out = F.lit(True)
        for part in self.all_of:
            out = out & part.column()
        if self.any_of:
            some = F.lit(False)
            for part in self.any_of:
                some = some | part.column()
            out = out & some
        return ~out if self.negate else out

    def features(self) -> set[str]:
        return set().union(*(p.features() for p in self.parts))

    def crossing(self) -> set[str]:
        return set().union(*(p.crossing() for p in self.parts))

    def parameters(self) -> set[str]:
        return set().union(*(p.parameters() for p in self.parts))

    def data(self) -> dict:
        return {"all_of": [p.data() for p in self.all_of], "any_of": [p.data() for p in self.any_of], "negate": self.negate}


def _part(x) -> Condition | Group:
    """A condition from a triple or an object with ``left``; a group from any other object."""
    if isinstance(x, (Condition, Group)):
        return x
    if isinstance(x, (list, tuple)) and len(x) == 3:
        return Condition(*x)
    if isinstance(x, Mapping):
        return Condition(x["left"], x.get("op"), x.get("right")) if "left" in x else group(x)
    raise ValueError(f"neither a condition nor a group: {x!r}")


def group(data: Mapping) -> Group:
    """A group from an object with all_of, any_of and negate."""
    if not isinstance(data, Mapping):
        raise ValueError("a rule is an object")
    if unknown := set(data) - {"all_of", "any_of", "negate"}:
        raise ValueError(f"unknown parts of a rule: {sorted(map(str, unknown))}")
    return Group(tuple(map(_part, data.get("all_of") or ())), tuple(map(_part, data.get("any_of") or ())), bool(data.get("negate", False)))


def all_of(*parts, any_of: Iterable = ()) -> Group:
    return group({"all_of": parts, "any_of": list(any_of)})


@dataclass(frozen=True)
class Exit:
    """Protective stop and target (in ATRs or as fractions), longest holding in bars, and conditions to leave on."""

    stop_atr_mult: float | str | None = 2.0
    target_atr_mult: float | str | None = None
    stop_pct: float | str | None = None
    target_pct: float | str | None = None
    max_holding_bars: float | str | None = 20
    exit_signal: Group | None = None

    def __post_init__(self):
        if self.stop_atr_mult is None and self.stop_pct is None:
            raise ValueError("every rule needs a protective stop")

    def values(self) -> dict:
        return {k: getattr(self, k) for k in ("stop_atr_mult", "target_atr_mult", "stop_pct", "target_pct", "max_holding_bars")}

    def data(self) -> dict:
        return self.values() | {"exit_signal": self.exit_signal.data() if self.exit_signal else None}


def exit_of(data: Mapping) -> Exit:
    if not isinstance(data, Mapping):
        raise ValueError("an exit is an object")
    if unknown := set(data) - {*Exit.__dataclass_fields__}:
        raise ValueError(f"unknown parts of an exit: {sorted(map(str, unknown))}")
    signal = data.get("exit_signal")
    return Exit(**{k: v for k, v in data.items() if k != "exit_signal"}, exit_signal=group(signal) if signal else None)


@dataclass(frozen=True)
class Spec:
    """A whole rule as data."""

    name: str
    family: str
    entry: Group
    exit: Exit = field(default_factory=Exit)
    params: dict[str, float] = field(default_factory=dict)
    version: int = 1
    description: str = ""

    def features(self) -> set[str]:
        return self.entry.features() | (self.exit.exit_signal.features() if self.exit.exit_signal else set())

    def parameters(self) -> set[str]:
        named = {v[1:] for v in self.exit.values().values() if isinstance(v, str) and v.startswith("$")}
        return named | self.entry.parameters() | (self.exit.exit_signal.parameters() if self.exit.exit_signal else set())

    def render(self, overrides: Mapping[str, float] | None = None) -> Spec:
        """The rule with its parameters put in; an unknown one is an error."""
        params = {**self.params, **(overrides or {})}
        if missing := self.parameters() - set(params):
            raise ValueError(f"unresolved parameters: {sorted(missing)}")
        put = _put(self.data(), params)
        return Spec(self.name, self.family, group(put["entry"]), exit_of(put["exit"]), params, self.version, self.description)

    def variants(self, grid: Mapping[str, Iterable[float]]) -> list[Spec]:
        """The product of the grid's values, each named by them."""
        out = []
        for values in itertools.product(*(list(v) for v in grid.values())):
            point = dict(zip(grid, values))
            name = f"{self.name}[{','.join(f'{k}={v}' for k, v in point.items())}]"
            done = self.render(point)
            out.append(Spec(name, done.family, done.entry, done.exit, done.params, done.version, done.description))
        return out

    def data(self) -> dict:
        return {"name": self.name, "family": self.family, "version": self.version, "description": self.description, "entry": self.entry.data(), "exit": self.exit.data(), "params": self.params}

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.data(), sort_keys=True).encode()).hexdigest()[:16]


def _put(x, params: Mapping[str, float]):
    if isinstance(x, dict):
        return {k: _put(v, params) for k, v in x.items()}
    if isinstance(x, list):
        return [_put(v, params) for v in x]
    return params[x[1:]] if isinstance(x, str) and x.startswith("$") and x[1:] in params else x


#: Names of the usual timeframes in seconds (fixed values); the shortest is not named.
LABELS = {60.0: "", 300.0: "@5min", 900.0: "@15min", 3600.0: "@1h", 14400.0: "@4h", 86400.0: "@1d"}


def rule_id(spec: Spec, symbol: str, timeframe_s: float = 60.0) -> str:
    """family:symbol:hash, and the timeframe where it is not the shortest."""
    done = spec.render()
    return f"{done.family}:{symbol}:{done.digest()[:8]}" + LABELS.get(timeframe_s, f"@{timeframe_s:g}s")


def with_previous(rows: DataFrame, groups: Iterable[Group | None], keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """Adds the value before of every feature that the groups' crossings look at, where the rows have it."""
    names = sorted(set().union(*(g.crossing() for g in groups if g)) & set(rows.columns))
    w = W.partitionBy(*keys).orderBy(order)
    return rows.withColumns({f"{BEFORE}{n}": F.lag(n).over(w) for n in names}) if names else rows


def signals(rows: DataFrame, specs: Iterable[Spec], keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """rows with a boolean column for each rule, named as it is: does it enter here? Rules that look at absent features are left out."""
    have = [s.render() for s in specs if s.features() <= set(rows.columns)]
    out = with_previous(rows, [s.entry for s in have], keys, order)
    return out.withColumns({s.name: s.entry.column() for s in have}).drop(*(c for c in out.columns if c.startswith(BEFORE)))
