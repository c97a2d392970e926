"""What several operators need: tables in the shared folder, connected components, and cuts of a distributed order."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is imported by now stays, so that no later search for cycles in a worker goes over it again.
gc.freeze()

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a local session gets a temporary one; a cluster must set it."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", made := "file://" + tempfile.mkdtemp(prefix="shared-"))
    return made


def save(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df` from a table written to the shared folder: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more."""
    for table in tables:
        for spark, path in [x for x in _made if x[1] == getattr(table, "_saved_at", None)]:
            _delete(spark, path)
            _made.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _leave_nothing() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended
            return


def column_named(df: DataFrame, wanted: str) -> str:
    """A name that no column of `df` has, however its letters are cased."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


#: What worker processes keep from task to task: caches that hold vocabularies and the words used of late.
_kept: list = []


def kept(cache: Callable) -> Callable:
    """`cache`, made by lru_cache; tidy() empties it in a worker process that goes on to other work."""
    _kept.append(cache)
    return cache


def _forget(keep: Callable | None) -> None:
    for cache in _kept:
        if cache is not keep:
            cache.cache_clear()


def tidy(run: Callable[[Iterator], Iterator], keep: Callable | None = None) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow, in a worker process that Spark uses again: afterwards freed memory goes back to the system.

    The functions here make many small objects and no cycles, so the search for cycles pauses while they run.
    keep: the cache of kept() that `run` uses; what other functions have left in the process goes first.
    """

    def whole(batches: Iterator) -> Iterator:
        _forget(keep)
        searched = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if searched:
                gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return whole


def shipped(df: DataFrame, path: str) -> tuple[str, str]:
    """Hands a vocabulary file, of fixed size, to every executor; returns its name there and a mark of its content."""
    df.sparkSession.sparkContext.addFile(path)
    return Path(path).name, hashlib.md5(Path(path).read_bytes()).hexdigest()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected `edges` (a, b), for each node with an edge.

    Alternates large-star and small-star until only stars are left; both aggregate before they shuffle neighbours, each round is
    written to the shared folder, and nothing but whether there is another graph than a star reaches the driver. Edges with a null end are dropped.
    """
    now = save(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "edges")
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = save(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        drop(now)
        now = after
        ends = now.select(F.col("a").alias("u"), F.lit(1).alias("down")).union(now.select("b", F.lit(0)))
        if not ends.groupBy("u").agg(F.sum("down").alias("down"), F.min("down").alias("least")).where("down > 1 or down = 1 and least = 0").limit(1).count():
            break  # each larger end has one smaller end, which is no larger one: stars
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).groupBy("node").agg(F.min("component").alias("component"))


def cuts(table: DataFrame, group: str, key: str, weight: str, targets: dict, fine: int = 2000, least: int = 200) -> dict:
    """For each group, where its rows in order of `key` (a long, 0 to 2**62 - 1) reach each of the given sums.

    targets: {group: [sum, ...]}. Returns {group: [(cut, sum below cut, [(key, weight), ...]), ...]}: rows with key < cut
    weigh no more than the target, and the list has, in order, the rows that follow: those of the last histogram bin, at
    most about `fine`, or those of one single key, and of the bins after it until there are `least` rows. Histograms of 4096 bins a group narrow the cut bin by bin, so what
    reaches the driver does not grow with the rows.
    """
    bits = 12
    open_ = {(g, i): (0, 62, 0, t) for g, ts in targets.items() for i, t in enumerate(ts)}  # low end, width in bits, sum below, target
    out: dict = {g: [None] * len(ts) for g, ts in targets.items()}
    spark = table.sparkSession
    while open_:
        spans = sorted({(str(g), lo, width) for (g, _), (lo, width, _, _) in open_.items()})
        small = spark.createDataFrame([(g, lo, lo + (1 << width), max(0, width - bits)) for g, lo, width in spans], "g string, lo bigint, hi bigint, step int")
        rows = table.select(F.col(group).cast("string").alias("g"), F.col(key).alias("k"), F.col(weight).cast("bigint").alias("w")).join(F.broadcast(small), "g").where("k >= lo and k < hi")
        bins: dict = {}
        for r in rows.groupBy("g", "lo", "step", F.expr("shiftright(k - lo, step)").alias("bin")).agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect():
            bins.setdefault((r.g, r.lo, r.step), []).append((r.bin, r.w, r.n))
        ready, deeper = {}, {}
        for (g, i), (lo, width, below, target) in open_.items():
            step = max(0, width - bits)
            dealt = sorted(bins.get((str(g), lo, step), []))
            for j, (b, w, n) in enumerate(dealt):
                if below + w > target:
                    at, end = lo + (b << step), lo + ((b + 1) << step)
                    if n <= fine or step == 0:
                        for more, _, m in dealt[j + 1 :]:
                            if n >= least or n + m > fine:
                                break
                            n, end = n + m, lo + ((more + 1) << step)
                        ready[(g, i)] = (at, end, below, target)
                    else:
                        deeper[(g, i)] = (at, step, below, target)
                    break
                below += w
            else:
                out[g][i] = (lo + (1 << width), below, [])
        if ready:
            small = spark.createDataFrame(sorted({(str(g), lo, hi) for (g, _), (lo, hi, _, _) in ready.items()}), "g string, lo bigint, hi bigint")
            rows = table.select(F.col(group).cast("string").alias("g"), F.col(key).alias("k"), F.col(weight).cast("bigint").alias("w")).join(F.broadcast(small), "g").where("k >= lo and k < hi")
            found: dict = {}
            for r in rows.groupBy("g", "lo", "k").agg(F.sum("w").alias("w")).collect():
                found.setdefault((r.g, r.lo), []).append((r.k, r.w))
            for (g, i), (lo, _, below, _) in ready.items():
                out[g][i] = (lo, below, sorted(found[(str(g), lo)]))
        open_ = deeper
    return out


def key62(*columns: Column, seed: int = 0) -> Column:
    """A seeded hash of the columns as a long from 0 to 2**62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 2)
