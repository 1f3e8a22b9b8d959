"""Exponential smoothing as a two-level scan.

y(0) = x(0), y(t) = (1 - a) y(t-1) + a x(t), over the non-null inputs of a series in order. Rows are numbered
and cut into blocks: inside a block a window sum gives the block's own part, and a fold over the last value of
every block (a row per BLOCK inputs) carries the smoothed value from block to block. Only that fold is
sequential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BLOCK = 256


def smooth(rows: DataFrame, inputs: dict[str, tuple[Column | str, float, int]], keys: tuple[str, ...] = ("symbol",), order: str = "ts", block: int = BLOCK) -> DataFrame:
    """Adds a column for each name: (input, alpha, least number of inputs before the value shows)."""
    series = W.partitionBy(*keys).orderBy(order)
    # Series of the same input share its blocks, and with them one sort.
    shared = {name: str(x) for name, (x, _, _) in inputs.items()}
    label = {x: name for name, x in reversed(shared.items())}
    group = {name: label[x] for name, x in shared.items()}
    out = rows.withColumns({f"_x_{g}": F.col(x) if isinstance(x, str) else x for g in set(group.values()) for x in [inputs[g][0]]})
    out = out.withColumns({f"_n_{g}": F.count(f"_x_{g}").over(series.rowsBetween(W.unboundedPreceding, 0)) for g in set(group.values())})
    ends, folds = [], []
    for g in dict.fromkeys(group.values()):
        n, x = F.col(f"_n_{g}") - 1, F.col(f"_x_{g}")
        out = out.withColumns({f"_b_{g}": F.when(F.col(f"_n_{g}") > 0, F.floor(n / block).cast("int")).otherwise(0), f"_k_{g}": F.pmod(n, F.lit(block))})
        inside = W.partitionBy(*keys, f"_b_{g}").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        own, k = {name: inputs[name][1] for name in inputs if group[name] == g}, F.col(f"_k_{g}")
        out = out.withColumns({f"_l_{name}": F.pow(F.lit(1 - a), k) * F.sum(F.when(x.isNotNull(), a * x * F.pow(F.lit(1 - a), -k))).over(inside) for name, a in own.items()})
        for name, a in own.items():
            end = F.when(x.isNotNull() & (k == block - 1), F.struct(F.col(f"_b_{g}").alias("b"), F.col(f"_l_{name}").alias("l")))
            ends += [F.sort_array(F.collect_list(end)).alias(f"_e_{name}"), F.min(F.when((F.col(f"_n_{g}") == 1) & x.isNotNull(), x)).alias(f"_f_{name}")]
            power = (1 - a) ** block
            folds.append(F.aggregate(f"_e_{name}", F.array(F.col(f"_f_{name}")), lambda c, e: F.concat(c, F.array(power * F.element_at(c, -1) + e["l"]))).alias(f"_c_{name}"))  # noqa: B023
    # One aggregate for all inputs: the rows are read twice, however many series are smoothed.
    carried = out.groupBy(*keys).agg(*ends).select(*keys, *folds)
    out = out.join(carried, list(keys), "left")
    shown = {}
    for name, (_, a, least) in inputs.items():
        g = group[name]
        y = F.pow(F.lit(1 - a), F.col(f"_k_{g}") + 1) * F.get(f"_c_{name}", F.col(f"_b_{g}")) + F.col(f"_l_{name}")
        shown[name] = F.when(F.col(f"_x_{g}").isNotNull() & (F.col(f"_n_{g}") >= least), y)
    return out.withColumns(shown).drop(*(f"_{p}_{n}" for n in inputs for p in "xnbklc"))
