"""Resharding by minimum-cost flow: the block transfers between shards that move the fewest bytes, then rewritten files.

Each row has an old shard; the new layout gives each shard a capacity in bytes. What stays costs nothing, what moves costs its
bytes, so the flow keeps in each shard as much as its capacity allows and routes only the excess. Within a shard rows have an
order in which equal texts stand together; each transfer is a stretch of that order. A cut falls between groups of equal
texts where the nearest such place is within `tolerance` of a capacity, and inside a group where that group is too large.

Null text has no bytes (and the CRC of none). Empty tables give no rows, repeated rows are placed each. Clashing names: the
operator's columns come last and take trailing underscores; none of the input's is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envatlas.llm.shared import _delete, column_named, cuts, save
from envatlas.llm.source_mixing import min_cost_flow

SHARDS = 16
#: Of a shard's capacity: how far a cut may stand from its exact place to keep equal texts together; the nearest such place is taken.
TOLERANCE = 0.025
SEED = 5
_TEXT_BITS, _DOC_BITS = 40, 22
_SPANS = 1024


def order_key(text: Column, ident: Column, seed: int = SEED) -> Column:
    """A long below 2**62: equal texts share the upper 40 bits, the lower 22 spread their documents."""
    high = F.shiftrightunsigned(F.xxhash64(F.lit(seed), text), 64 - _TEXT_BITS)
    return F.shiftleft(high, _DOC_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), ident), 64 - _DOC_BITS))


def transfers(old: dict[int, int], capacity: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard, of the least moved bytes; capacities must sum to the old sizes."""
    if sum(old.values()) != sum(capacity.values()):
        raise ValueError("capacities must sum to the sizes")
    a, b = sorted(old), sorted(capacity)
    sink = 1 + len(a) + len(b)
    edges = [(0, 1 + i, old[x], 0) for i, x in enumerate(a)] + [(1 + len(a) + j, sink, capacity[y], 0) for j, y in enumerate(b)]
    middle = [(x, y) for x in a for y in b]
    edges += [(1 + a.index(x), 1 + len(a) + b.index(y), old[x], int(x != y)) for x, y in middle]
    flow = min_cost_flow(sink + 1, edges, 0, sink)[len(a) + len(b) :]
    return {k: f for k, f in zip(middle, flow, strict=True) if f}


def equal_capacities(total: int, shards: int = SHARDS) -> dict[int, int]:
    return {i: total // shards + (i < total % shards) for i in range(shards)}


def _snapped(cut: tuple, target: int, within: float) -> int:
    """The place of a cut: between two groups of equal texts if one is near enough, else nearest to the target."""
    at, below, following = cut
    places, sums = [(at, below)], below
    for key, weight in following:
        sums += weight
        places.append((key + 1, sums))
        if sums - target > within and sums > target:
            break
    texts = [k for k, _ in following] and {k >> _DOC_BITS for k, _ in following}
    between = [(abs(s - target), k) for i, (k, s) in enumerate(places) if i and (i == len(following) or following[i][0] >> _DOC_BITS != following[i - 1][0] >> _DOC_BITS)]
    if at & ((1 << _DOC_BITS) - 1) == 0 and texts:
        between.append((abs(below - target), at))
    near = [x for x in between if x[0] <= within]
    return min(near or [(abs(s - target), k) for k, s in places])[1]


def reshard(df: DataFrame, size: Column, old_shard: Column, key: Column, capacity=None, shards: int = SHARDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """Rows with shard_size, old_shard, shard_key and new_shard, and the transfers. The driver gets sizes by shard and histograms only.

    A row without an old shard counts to shard 0.
    """
    own = [column_named(df, c) for c in ("shard_size", "old_shard", "shard_key", "new_shard")]
    # the input's columns travel as one, so that none can be taken for one of the operator's
    rows = save(df.select(F.struct("*").alias("row"), size.cast("bigint").alias("shard_size"), F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"), key.alias("shard_key")), "reshard")
    old = {r.old_shard: r.n for r in rows.groupBy("old_shard").agg(F.sum("shard_size").alias("n")).collect()}
    capacity = capacity or equal_capacities(sum(old.values()), shards)
    plan = transfers(old, capacity)
    goes: dict[int, list] = {}
    for (a, b), n in sorted(plan.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):  # what stays comes first
        goes.setdefault(a, []).append((b, n))
    targets = {a: [sum(n for _, n in to[: i + 1]) for i in range(len(to) - 1)] for a, to in goes.items() if len(to) > 1}
    found = cuts(rows, "old_shard", "shard_key", "shard_size", targets)
    spans = []
    for a, to in goes.items():
        places = [_snapped(c, t, tolerance * max(1, capacity[to[i][0]])) for i, (c, t) in enumerate(zip(found.get(a, []), targets.get(a, []), strict=True))]
        ends = [*places, 1 << 62]
        spans += [(a, 0 if not i else ends[i - 1], ends[i], b) for i, (b, _) in enumerate(to)]
    # at most shards * shards rows, from the flow
    table = F.broadcast(df.sparkSession.createDataFrame(spans, "old_shard int, lo bigint, hi bigint, new_shard int"))
    out = rows.join(table, "old_shard").where("shard_key >= lo and shard_key < hi")
    return out.select("row.*", *[F.col(c).alias(o) for c, o in zip(("shard_size", "old_shard", "shard_key", "new_shard"), own, strict=True)]), plan


def with_slots(df: DataFrame, shard: str, key: str, *ties: str) -> DataFrame:
    """Adds slot, gapless from 0 in each shard, without ordering a whole shard in one task.

    A shard is dealt into spans by the key's lowest bits, which spread equal texts too; slots count within a span, and each
    span starts where the counts of those before it end.
    """
    slot = column_named(df, "slot")
    packed = df.select(F.struct("*").alias("row"), F.col(shard).alias("s"), F.col(key).alias("k"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)])
    rows = packed.withColumn("span", F.col("k").bitwiseAND(F.lit(_SPANS - 1)).cast("int"))
    counts = rows.groupBy("s", "span").agg(F.count("*").alias("n"))
    start = F.sum("n").over(Window.partitionBy("s").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    # at most shards * _SPANS rows
    starts = F.broadcast(counts.select("s", "span", F.coalesce(start, F.lit(0)).alias("start")))
    here = F.row_number().over(Window.partitionBy("s", "span").orderBy("k", *[f"t{i}" for i in range(len(ties))])) - 1
    return rows.withColumn("here", here).join(starts, ["s", "span"]).select("row.*", (F.col("start") + F.col("here")).cast("bigint").alias(slot))


def rewrite(placed: DataFrame, root: str, shard: str = "new_shard", old: str = "old_shard") -> list[int]:
    """Writes anew, under root/shard=N, the shards that a transfer touched; the others' files stay as they are. Returns those written.

    `placed` must not read from `root`: each affected shard is written beside its place, the old one is set aside, the new one takes its
    place, and only when all stand is what was set aside deleted. If the driver is lost on the way, the next call first puts back what is missing.
    """
    spark = placed.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    new, aside = f"{root}/_new", f"{root}/_old"
    if fs.exists(path(aside)):
        for f in fs.listStatus(path(aside)):
            home = path(f"{root}/{f.getPath().getName()}")
            if not fs.exists(home):
                fs.rename(f.getPath(), home)
        _delete(spark, aside)
    touched = sorted({x for r in placed.where(F.col(shard) != F.col(old)).select(shard, old).distinct().collect() for x in r})
    if touched:
        placed.where(F.col(shard).isin(touched)).withColumn("shard", F.col(shard)).drop(old, shard, "shard_key", "shard_size").write.mode("overwrite").partitionBy("shard").parquet(new)
        fs.mkdirs(path(aside))
        for s in touched:
            if fs.exists(path(f"{root}/shard={s}")):
                fs.rename(path(f"{root}/shard={s}"), path(f"{aside}/shard={s}"))
            if fs.exists(path(f"{new}/shard={s}")):
                fs.rename(path(f"{new}/shard={s}"), path(f"{root}/shard={s}"))
        _delete(spark, aside)
        _delete(spark, new)
    return touched
