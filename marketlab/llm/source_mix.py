"""Mixing overlapping sources to target weights by a minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources that list them). A pattern's
words flow to the quotas of its sources; each further repetition of a pattern costs more than the
one before, so repetition spreads. The flow of a pattern then becomes whole passes over its documents
plus one partial pass, whose documents are chosen by a seeded hash until the flow is used up.

Only pattern totals reach the driver: a row per distinct membership pattern, never per document.
Selection uses bucketed prefix sums: totals of hash buckets locate the cut, and only the bucket that
holds it is ordered row by row.

Defined cases: null text has size 0 and is never taken; a null source is a source of its own, after
all others; no sources or no words give targets of 0; repeated rows are chosen as separate documents;
ties of the hash go by id, source and size, so reruns agree.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from marketlab.llm._store import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MAX_REPEATS, BUCKETS, SEED = (5, 2, 1), 3, 16384, 17


def repeat_costs(times: int) -> tuple[int, ...]:
    """Convex costs of the first, second, .. taking of a word: 0, 1, 3, 6, .."""
    return tuple(k * (k + 1) // 2 for k in range(times))


def targets(sizes: dict, weights: dict, total: int | None = None, cap: float = MAX_REPEATS) -> dict:
    """Shares of the total by weight; what exceeds ``cap`` times a source's size goes to the others by weight."""
    total = sum(sizes.values()) if total is None else total
    out: dict = {}
    free, left = [s for s in sizes], float(total)
    while free:
        weight = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / weight > cap * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / weight for s in free}
        for s in over:
            out[s] = float(cap * sizes[s])
        left = max(0.0, total - sum(out.values()))
        free = [s for s in free if s not in out]
    return out


def min_cost_flow(capacity: dict, quotas: dict, costs: tuple[int, ...] = repeat_costs(MAX_REPEATS)) -> dict:
    """Words (pattern, source) -> flow. Successive shortest paths over pattern -> source -> sink; patterns are tuples of sources.

    A pattern offers its capacity once for each entry of ``costs``, at that entry's cost a word.
    """
    nodes = {"source": 0, "sink": 1}
    graph: list[list[list]] = [[], []]

    def node(x) -> int:
        if x not in nodes:
            nodes[x] = len(graph)
            graph.append([])
        return nodes[x]

    def edge(a: int, b: int, room: int, cost: int) -> list:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])
        return graph[a][-1]

    links = {}
    for p, size in capacity.items():
        for cost in costs:
            edge(0, node(("p", p)), int(size), cost)
        for s in p:
            links[p, s] = edge(node(("p", p)), node(("s", s)), 1 << 62, 0), node(("s", s))
    for s, quota in quotas.items():
        edge(node(("s", s)), 1, round(quota), 0)

    potential = [0] * len(graph)
    while True:
        far, via = [math.inf] * len(graph), [None] * len(graph)
        far[0], queue = 0, [(0, 0)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                if room > 0 and (e := d + cost + potential[a] - potential[b]) < far[b]:
                    far[b], via[b] = e, (a, k)
                    heapq.heappush(queue, (e, b))
        if far[1] == math.inf:
            break
        potential = [p + (d if d < math.inf else 0) for p, d in zip(potential, far)]
        push, b = 1 << 62, 1
        while b:
            a, k = via[b]
            push, b = min(push, graph[a][k][1]), a
        b = 1
        while b:
            a, k = via[b]
            graph[a][k][1] -= push
            graph[b][graph[a][k][3]][1] += push
            b = a
    return {key: graph[s][e[3]][1] for key, (e, s) in links.items()}


def sized_columns(id_col: str, text_col: str, sources=None) -> list:
    listed = F.array(F.col("source")) if sources is None else F.coalesce(sources, F.array(F.lit(None).cast("string")))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return [F.col(id_col).alias("id"), size.alias("size"), F.array_sort(F.array_distinct(listed)).alias("pattern")]


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources=None) -> DataFrame:
    """id, size in words, and the sorted array of sources (by default the one of column ``source``)."""
    return docs.select(*sized_columns(id_col, text_col, sources))


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, total: int | None = None) -> tuple[list[tuple], dict, dict]:
    """(pattern, source, flow) rows, target by source, and size by source, from pattern totals."""
    totals = {tuple(r["pattern"]): r["size"] for r in sizes.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
    names = sorted({s for p in totals for s in p}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    size = {s: sum(n for p, n in totals.items() if s in p) for s in names}
    goal = targets(size, weight, sum(totals.values()) if total is None else total, max_repeats)
    flow = min_cost_flow(totals, goal, repeat_costs(max_repeats))
    return [(p, s, f) for (p, s), f in flow.items()], goal, size


def select(rows: DataFrame, flows: dict[tuple, int], sizes: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """Adds ``copies``: whole passes of a pattern's flow, and one more for seeded documents while they fit.

    rows: has id, size and pattern, and keeps its other columns; sizes: the same three columns, cheaper to read.
    """
    spark = rows.sparkSession
    quota = spark.createDataFrame([(list(p), int(f)) for p, f in flows.items()], "quota_of array<string>, flow long")
    rank = F.xxhash64(F.lit(seed), F.col("id").cast("string"))
    bucket = F.pmod(F.shiftright(rank, 40), F.lit(BUCKETS)).cast("int")
    # A row a pattern and bucket: bounded by BUCKETS times the patterns, not by the documents.
    sums = (rows if sizes is None else sizes).groupBy("pattern", bucket.alias("bucket")).agg(F.sum("size").alias("in_bucket"))
    up_to = F.sum("in_bucket").over(W.partitionBy("pattern").orderBy("bucket"))
    # A row a pattern, the same ones whose totals made the flow: where its partial pass ends.
    cut = sums.withColumn("up_to", up_to).groupBy("pattern").agg(F.max("up_to").alias("whole"), F.sort_array(F.collect_list(F.struct("bucket", "up_to", "in_bucket"))).alias("buckets"))
    cut = cut.join(F.broadcast(quota), F.col("pattern").eqNullSafe(F.col("quota_of")), "left").select(
        F.col("pattern").alias("cut_of"),
        F.when(F.col("whole") > 0, F.floor(F.coalesce("flow", F.lit(0)) / F.col("whole"))).otherwise(0).cast("int").alias("passes"),
        F.when(F.col("whole") > 0, F.pmod(F.coalesce("flow", F.lit(0)), F.col("whole"))).otherwise(0).cast("long").alias("goal"),
        "buckets",
    )
    first = F.get(F.filter("buckets", lambda b: b["up_to"] > F.col("goal")), F.lit(0))
    cut = cut.select("cut_of", "passes", (F.col("goal") - first["up_to"] + first["in_bucket"]).alias("room"), first["bucket"].alias("cut"))
    joined = rows.withColumns({"rank": rank, "bucket": bucket}).join(F.broadcast(cut), F.col("pattern").eqNullSafe(F.col("cut_of")), "left")
    plain = joined.where("cut is null or bucket <> cut").withColumn("copies", F.col("passes") + F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)).cast("int"))
    order = W.partitionBy("pattern").orderBy("rank", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    edge = joined.where("bucket = cut").withColumn("run", F.sum("size").over(order)).withColumn("copies", F.col("passes") + (F.col("run") <= F.col("room")).cast("int")).drop("run")
    return plain.unionByName(edge).drop("rank", "bucket", "cut_of", "passes", "room", "cut")


def _flows(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int, total: int | None) -> tuple[dict, dict, dict]:
    rows, goal, size = plan(sizes, weights, max_repeats, total)
    flows: dict[tuple, int] = {}
    for p, _, f in rows:
        flows[p] = flows.get(p, 0) + f
    return flows, goal, size


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources=None, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, total: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(id, ``size``, ``pattern`` and ``taken`` of every document; ``source``, ``source_size`` and ``target`` of every source)."""
    sizes = materialize(sized(docs, id_col, text_col, sources), "sizes")
    flows, goal, size = _flows(sizes, weights, max_repeats, total)
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    goals = sizes.sparkSession.createDataFrame([(s, int(size[s]), float(goal[s])) for s in goal], schema)
    return select(sizes, flows, seed=seed).select(F.col("id").alias(id_col), "size", "pattern", (F.col("copies") * F.col("size")).alias("taken")), goals


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources=None, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, total: int | None = None, seed: int = SEED) -> DataFrame:
    """The documents that the mix takes, all columns as they were, a row for each time a document is taken."""
    sizes = materialize(sized(docs, id_col, text_col, sources), "sizes")
    flows, _, _ = _flows(sizes, weights, max_repeats, total)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c for c in sized_columns(id_col, text_col, sources)))
    taken = select(rows, flows, sizes, seed).where("copies > 0 and size > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
