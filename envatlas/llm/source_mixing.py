"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents may belong to several overlapping sources. They are aggregated to one row a membership pattern, so the network has
a node for each pattern and each source, however many documents there are. A pattern offers its words once at cost 1 and,
up to the bound on repeats, again at growing cost, so that costs are convex and no text repeats while fresh words can
still serve; each source asks for its target. The flow says how many words each pattern gives, and a seeded order of its documents decides
which: all of them for each full round, then those that come first until the rest is reached, closed up by the greedy
choice among the next ones that leaves the smallest gap.

Null texts have no words. A null source is a source of its own, last in order. An empty table gives no rows; repeated rows
count each. Columns of any name pass through. Sources without words get target 0. Documents of equal id and text stand next to each other in the seeded order and share its decision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envatlas.llm.arrowtext import words
from envatlas.llm.shared import column_named, cuts, key62, save, tidy

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2
SEED = 11
#: Patterns the driver solves for; more are refused, not dropped.
MOST_PATTERNS = 100_000


def with_sizes(df: DataFrame, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Adds `size`, the number of words of the whole text."""
    own = column_named(df, "size")
    where = df.columns.index(text)
    fields = [f for i, f in enumerate(df.schema.fields) if not (drop_text and i == where)]
    schema = T.StructType([*fields, T.StructField(own, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([w.counts() for w in words(batch.column(where))] or [np.zeros(0, dtype=np.int64)])
            kept = [c for i, c in enumerate(batch.columns) if not (drop_text and i == where)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, type=pa.int64())], names=[f.name for f in schema.fields])

    return df.mapInArrow(tidy(run), schema)


def capped_targets(sizes: dict, weights: dict, share: float = SHARE, most: float = MOST_REPEATS) -> dict:
    """Shares share * (sum of sizes) by weight; a target stops at `most` times its source's size, and the excess is shared again."""
    left, out = share * sum(sizes.values()), {}
    open_ = dict(weights)
    while open_:
        total = sum(open_.values())
        full = {k for k, w in open_.items() if left * w / total >= most * sizes[k]}
        if not full:
            return out | {k: left * w / total for k, w in open_.items()}
        for k in sorted(full, key=str):
            out[k] = float(most * sizes[k])
            left -= out[k]
            del open_[k]
    return out


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """The flow on each (from, to, capacity, cost) of a maximum flow of least cost, by shortest augmenting paths with potentials."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, room, cost = [], [], []
    for a, b, c, w in edges:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            room.append(z)
            cost.append(v)
    height = [0] * n
    while True:
        far, by = [None] * n, [-1] * n
        far[source], heap = 0, [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in graph[x]:
                if room[e] > 0:
                    y, z = to[e], d + cost[e] + height[x] - height[to[e]]
                    if far[y] is None or z < far[y]:
                        far[y], by[y] = z, e
                        heapq.heappush(heap, (z, y))
        if far[sink] is None:
            return [room[2 * i + 1] for i in range(len(edges))]
        for x in range(n):
            if far[x] is not None:
                height[x] += far[x]
        x, step = sink, None
        while x != source:
            step = room[by[x]] if step is None else min(step, room[by[x]])
            x = to[by[x] ^ 1]
        x = sink
        while x != source:
            room[by[x]] -= step
            room[by[x] ^ 1] += step
            x = to[by[x] ^ 1]


def route(capacity: dict[str, int], members: dict[str, list], quotas: dict, most: int = MOST_REPEATS) -> dict[str, int]:
    """Words that each pattern gives, so that sources come as near their quotas as the patterns allow at least repetition cost."""
    patterns, sources = sorted(capacity), sorted({s for m in members.values() for s in m}, key=lambda s: (s is None, str(s)))
    at_s = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    sink = 1 + len(patterns) + len(sources)
    edges = [(0, 1 + i, capacity[p], 1 << k) for i, p in enumerate(patterns) for k in range(most)]
    edges += [(1 + i, at_s[s], most * capacity[p], 0) for i, p in enumerate(patterns) for s in members[p]]
    edges += [(at_s[s], sink, round(quotas[s]), 0) for s in sources]
    flow = min_cost_flow(sink + 1, edges, 0, sink)
    return {p: sum(flow[most * i : most * i + most]) for i, p in enumerate(patterns)}


def close_gap(gap: int, following: list[tuple[int, int]]) -> set[int]:
    """Keys to take besides: each that fits, in order, then one more if that comes nearer."""
    took, left = set(), gap
    for key, size in following:
        if 0 < size <= left:
            took.add(key)
            left -= size
    rest = [(abs(left - size), key) for key, size in following if key not in took and size > 0]
    if rest and min(rest)[0] < left:
        took.add(min(rest)[1])
    return took


def mix(df: DataFrame, membership: Column, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS, seed: int = SEED, ident: str = "doc_id", text: str = "text", keep_text: bool = False) -> tuple[DataFrame, dict, dict]:
    """The rows with mix_size, mix_pattern, mix_copies (how often the mix takes the document), and {source: size}, {source: target}.

    `membership` is an array of strings (null element: the null source); a document in no source is never taken. `weights`
    repeat over the sources in order of code point, null last. Sizes, targets and flows are kept a pattern; of the documents
    the driver sees histograms and the few rows at each pattern's cut. The three columns come last; where the input has such a name, they take a
    trailing underscore, and no column of the input is lost or read as one of the operator's.
    """
    kept = [c for c in df.columns if keep_text or c != text]
    own = [column_named(df, c) for c in ("mix_size", "mix_pattern", "mix_copies")]
    # the input's columns travel as one, so that none can be taken for one of the operator's
    packed = df.select(F.struct(*[df[c] for c in kept]).alias("row"), df[text].cast("string").alias("text"), F.array_sort(F.array_distinct(membership)).alias("mix_members"), key62(df[ident].cast("string"), df[text], seed=seed).alias("mix_key"))
    rows = with_sizes(packed, "text", drop_text=True)
    rows = rows.withColumnRenamed(rows.columns[-1], "mix_size").withColumn("mix_pattern", F.to_json(F.struct("mix_members"), {"ignoreNullFields": "false"}))
    rows = save(rows, "mix")
    have = rows.groupBy("mix_pattern").agg(F.sum("mix_size").alias("n"), F.first("mix_members").alias("m")).limit(MOST_PATTERNS + 1).collect()
    if len(have) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    capacity, members = {r.mix_pattern: r.n for r in have}, {r.mix_pattern: list(r.m or []) for r in have}
    sources = sorted({s for m in members.values() for s in m}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(capacity[p] for p, m in members.items() if s in m) for s in sources}
    targets = capped_targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(sources)}, share, most)
    flow = route(capacity, members, targets, most)
    rounds = {p: (f // capacity[p], f % capacity[p]) if capacity[p] else (0, 0) for p, f in flow.items()}
    found = cuts(rows, "mix_pattern", "mix_key", "mix_size", {p: [rest] for p, (_, rest) in rounds.items() if rest})
    plan, extra = [], []
    for p, (whole, rest) in rounds.items():
        cut, below, following = found[p][0] if rest else (0, 0, [])
        plan.append((p, whole, cut))
        extra += [(p, k) for k in close_gap(rest - below, following)]
    spark = df.sparkSession
    plan_ = spark.createDataFrame(plan, "mix_pattern string, whole int, cut bigint")
    extra_ = spark.createDataFrame(extra, "mix_pattern string, mix_key bigint").withColumn("more", F.lit(1))
    # one row a pattern, and the closing documents of each pattern: their number is bounded by MOST_PATTERNS and cuts()
    out = rows.join(F.broadcast(plan_) if len(plan) <= 10_000 else plan_, "mix_pattern", "left")
    out = out.join(F.broadcast(extra_) if len(extra) <= 100_000 else extra_, ["mix_pattern", "mix_key"], "left")
    copies = F.coalesce(F.col("whole"), F.lit(0)) + F.when((F.col("mix_key") < F.col("cut")) | F.col("more").isNotNull(), 1).otherwise(0)
    out = out.select("row.*", F.col("mix_size").alias(own[0]), F.col("mix_pattern").alias(own[1]), F.when(F.col("mix_size") > 0, copies).otherwise(0).alias(own[2]))
    return out, sizes, targets
