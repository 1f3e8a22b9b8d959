"""Proposed experiments as rows of JSON: each is checked and becomes a rule, or is refused with a reason; copies of earlier ones are left out.

The checks of one proposal are a small function of its text; rows are checked where they lie.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.plans.conditions import Spec, exit_of, group

NAME = re.compile(r"[a-z][a-z0-9_]{2,39}")
MOST_VARIANTS, MOST_VALUES = 8, 4


def _refuse_unless(test: bool, why: str) -> None:
    if not test:
        raise ValueError(why)


def _is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def checked(raw: dict, features: set[str], timeframes: tuple[str, ...], most_variants: int = MOST_VARIANTS) -> tuple[Spec, str, dict]:
    """(rule, timeframe, grid) of one proposal, or a ValueError that says what is wrong with it."""
    _refuse_unless(isinstance(raw, dict), "a proposal is an object")
    name = str(raw.get("name", "")).strip().lower()
    _refuse_unless(bool(NAME.fullmatch(name)), f"invalid name {name!r}")
    timeframe = str(raw.get("timeframe", ""))
    _refuse_unless(timeframe in timeframes, f"timeframe {timeframe!r} is not allowed")
    params, grid = raw.get("params") or {}, raw.get("grid") or {}
    _refuse_unless(isinstance(params, dict) and isinstance(grid, dict), "params and grid are objects")
    for k, values in grid.items():
        _refuse_unless(isinstance(values, list) and 1 <= len(values) <= MOST_VALUES, f"grid entry {k!r} needs 1 to {MOST_VALUES} values")
    for k, v in [*params.items(), *((k, v) for k, values in grid.items() for v in values)]:
        _refuse_unless(_is_number(v), f"parameter {k!r} is not a number")
    _refuse_unless(set(grid) <= set(params), f"grid without a default: {sorted(set(grid) - set(params))}")
    count = 1
    for values in grid.values():
        count *= len(values)
    _refuse_unless(count <= most_variants, f"{count} combinations of parameters (at most {most_variants})")
    try:
        spec = Spec(f"ai_{name}", "ai", group(raw.get("entry")), exit_of(raw.get("exit") or {}), params, 1, str(raw.get("claim", ""))[:240])
        for point in itertools.product(*grid.values()):
            spec.render(dict(zip(grid, point)))
        spec.render()
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        raise ValueError(f"invalid rule: {str(e)[:200]}") from e
    _refuse_unless(spec.exit.max_holding_bars is not None, "max_holding_bars is required")
    unknown = sorted(spec.features() - features)
    _refuse_unless(not unknown, f"unknown features {unknown}")
    return spec, timeframe, grid


def identity(spec: Spec, timeframe: str, grid: dict) -> str:
    """A hash of what an experiment does, whatever it is called."""
    body = {"timeframe": timeframe, "entry": spec.entry.data(), "exit": spec.exit.data(), "params": spec.params, "grid": grid}
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16]


def validate(proposals: DataFrame, features: set[str], timeframes: tuple[str, ...], most_variants: int = MOST_VARIANTS, column: str = "payload") -> DataFrame:
    """proposals with ``rule`` (its name), ``rule_key``, ``spec`` (canonical JSON) and ``reason`` (null: accepted); text that is no JSON is refused like any other fault."""

    def one(text: str | None) -> tuple[str | None, str | None, str | None, str | None]:
        try:
            spec, timeframe, grid = checked(json.loads(text or ""), features, timeframes, most_variants)
        except json.JSONDecodeError:
            return None, None, None, "not JSON"
        except ValueError as e:
            return None, None, None, str(e)
        return spec.name, identity(spec, timeframe, grid), json.dumps(spec.data(), sort_keys=True), None

    names = ("rule", "rule_key", "spec", "reason")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t) for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[i] for f in found], pa.string()) for i in range(4))], names=[*batch.schema.names, *names])

    plain = proposals.drop(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields) + "".join(f", {n} string" for n in names)
    # A file of short texts is one task's work to read, and many minutes' to check: rows are dealt out first.
    return plain.repartition(4 * plain.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)


def new_ones(validated: DataFrame, earlier: DataFrame, order: str) -> DataFrame:
    """Accepted proposals whose experiment is in neither ``earlier`` (rule_key) nor an earlier row."""
    rows = validated.where("reason is null").groupBy("rule_key").agg(F.min_by(F.struct(*(c for c in validated.columns if c != "rule_key")), order).alias("_r")).select("rule_key", "_r.*")
    return rows.join(earlier.select("rule_key").distinct(), "rule_key", "left_anti").select(*validated.columns)
