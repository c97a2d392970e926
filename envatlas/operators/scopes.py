"""Scopes: nesting, visibility, and the innermost scope around a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envatlas.functions import ranges
from envatlas.functions.settled import settled

ROOT = 1


def numbered(spans: DataFrame) -> DataFrame:
    """(file_id, scope_id, parent_id, kind, start, end, size): ids from 2 in order of start, the root is 1.

    `spans` has file_id, kind, sl, sc, el, ec of properly nested scopes. One sorted sweep a file: the parent is the last scope before that has not
    ended, kept as the stack of open ends while the file's scopes pass. A file's scopes are bounded by its text.
    """
    rows = spans.withColumns({"start": ranges.point(F.col("sl"), F.col("sc")), "end": ranges.point(F.col("el"), F.col("ec")), "size": ranges.size(F.col("sl"), F.col("sc"), F.col("el"), F.col("ec"))})
    one = F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "kind", "size")))
    empty = F.struct(F.array().cast("array<struct<id:int,end:bigint>>").alias("open"), F.array().cast("array<int>").alias("parents"))

    def step(state: Column, x: Column) -> Column:
        still = F.filter(state["open"], lambda o: o["end"] >= -x["back"])
        own = F.size(state["parents"]) + 2
        parent = F.when(F.size(still) > 0, F.element_at(still, -1)["id"]).otherwise(F.lit(ROOT))
        return F.struct(F.concat(still, F.array(F.struct(own.alias("id"), (-x["back"]).alias("end")))).alias("open"), F.concat(state["parents"], F.array(parent)).alias("parents"))

    files = rows.groupBy("file_id").agg(one.alias("s")).withColumn("p", F.aggregate("s", empty, step, lambda state: state["parents"]))
    each = files.select("file_id", F.posexplode(F.arrays_zip("s", "p")).alias("i", "x"))
    return each.select("file_id", (F.col("i") + 2).alias("scope_id"), F.col("x.p").alias("parent_id"), F.col("x.s.kind").alias("kind"), F.col("x.s.start").alias("start"), (-F.col("x.s.back")).alias("end"), F.col("x.s.size").alias("size"))


def scope_at(probes: DataFrame, scopes: DataFrame, key: str = "file_id", probe: str = "probe_id", at: str = "at") -> DataFrame:
    """Adds scope_id, the smallest scope that holds the position, ties to the least id; the root where none does.

    Scopes are posted to the largest aligned blocks of positions that they fill or overlap: a scope of length n to the blocks of the power of two
    at least n (two at most), and a probe to its block of each size that occurs. So a probe meets, by equality, few scopes but those around it.
    """
    s = scopes.select(key, "scope_id", "start", "end", "size").where(F.col("end") > F.col("start"))
    level = F.ceil(F.log2(F.greatest(F.col("end") - F.col("start"), F.lit(1)))).cast("int")
    s = s.withColumn("level", level)
    s = s.withColumn("block", F.explode(F.array_distinct(F.array(F.expr("shiftright(start, level)"), F.expr("shiftright(end - 1, level)")))))
    levels = s.groupBy(key).agg(F.collect_set("level").alias("levels"))  # 63 a file at most
    asked = probes.select(key, probe, at).join(levels, key).withColumn("level", F.explode("levels")).withColumn("block", F.expr(f"shiftright({at}, level)"))
    hits = asked.join(s, [key, "level", "block"]).where(ranges.contains_position(F.col("start"), F.col("end"), F.col(at)))
    best = hits.groupBy(key, probe).agg(F.min(F.struct("size", "scope_id")).alias("best"))
    return probes.join(best, [key, probe], "left").select(*probes.columns, F.coalesce("best.scope_id", F.lit(ROOT)).alias("scope_id"))


def closure(scopes: DataFrame) -> DataFrame:
    """(file_id, scope_id, ancestor_id, depth): each scope's ancestors, itself at depth 0, the root last, at any depth.

    Each round joins the rows of the largest depth with all rows so far, which doubles the depth reached, until no row has it.
    """
    known = scopes.select("file_id", "scope_id", F.explode(F.array(F.struct(F.col("scope_id").alias("ancestor_id"), F.lit(0).alias("depth")), F.struct(F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth")))).alias("x")).select("file_id", "scope_id", "x.*")
    known, reach = settled(known), 1
    while True:
        front = known.where(F.col("depth") == reach)
        if not front.limit(1).count():
            return known
        on = known.where("depth > 0").select("file_id", F.col("scope_id").alias("ancestor_id"), F.col("ancestor_id").alias("next"), F.col("depth").alias("more"))
        known = settled(known.unionByName(front.join(on, ["file_id", "ancestor_id"]).select("file_id", "scope_id", F.col("next").alias("ancestor_id"), (F.col("depth") + F.col("more")).alias("depth"))))
        reach *= 2


def overlapping(scopes: DataFrame, windows: DataFrame) -> DataFrame:
    """(file_id, scope_id, window_id) of scopes that overlap windows (file_id, window_id, start, end); touching is not overlapping.

    Both sides are dealt into buckets of 64 lines and meet where the later one begins, so that a long file's scopes don't all meet all windows.
    """
    a = bucketed(scopes.select("file_id", "scope_id", "start", "end"), "start", "end")
    b = bucketed(windows.select("file_id", "window_id", F.col("start").alias("ws"), F.col("end").alias("we")), "ws", "we")
    hit = a.join(b, ["file_id", "bucket"]).where(ranges.overlap(F.col("start"), F.col("end"), F.col("ws"), F.col("we")))
    return hit.where(F.col("bucket") == F.greatest(bucket(F.col("start")), bucket(F.col("ws")))).select("file_id", "scope_id", "window_id")


def overlap_counts(scopes: DataFrame, windows: DataFrame) -> DataFrame:
    """(file_id, window_id, n): how many rows overlapping() has for each window that has some; no start may be after its end.

    No pair is made: the scopes that overlap a window are those that start before its end but for those that end by its start, and both are running
    sums over a file's distinct positions, which its text bounds. An empty scope at an empty window's place is among the ended only, and is given back.
    """
    s = scopes.where("start is not null and end is not null").groupBy("file_id", "start", "end").agg(F.count("*").alias("c"))
    w = windows.select("file_id", "window_id", F.col("start").alias("ws"), F.col("end").alias("we")).where("ws is not null and we is not null")
    none = F.lit(0).cast("bigint")
    marks = F.array(F.struct(F.col("start").alias("at"), F.col("c").alias("started"), none.alias("ended"), F.when(F.col("start") == F.col("end"), F.col("c")).otherwise(none).alias("empty")), F.struct(F.col("end").alias("at"), none.alias("started"), F.col("c").alias("ended"), none.alias("empty")))
    asked = w.select("file_id", F.explode(F.array("ws", "we")).alias("at")).distinct().select("file_id", "at", none.alias("started"), none.alias("ended"), none.alias("empty"))
    at = s.select("file_id", F.explode(marks).alias("x")).select("file_id", "x.*").unionByName(asked).groupBy("file_id", "at").agg(F.sum("started").alias("started"), F.sum("ended").alias("ended"), F.sum("empty").alias("empty"))
    upto = Window.partitionBy("file_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sums = at.select("file_id", "at", (F.sum("started").over(upto) - F.col("started")).alias("before"), F.sum("ended").over(upto).alias("ended"), "empty")
    spans = w.groupBy("file_id", "ws", "we").agg(F.count("*").alias("many"))
    spans = spans.join(sums.select("file_id", F.col("at").alias("ws"), "ended", "empty"), ["file_id", "ws"]).join(sums.select("file_id", F.col("at").alias("we"), "before"), ["file_id", "we"])
    n = F.col("before") - F.col("ended") + F.when(F.col("ws") == F.col("we"), F.col("empty")).otherwise(none)
    return w.join(spans.select("file_id", "ws", "we", n.alias("n")).where("n > 0"), ["file_id", "ws", "we"]).select("file_id", "window_id", "n")


def bucket(point: Column) -> Column:
    """The bucket of 64 lines that a position of ranges.point() stands in."""
    return F.shiftright(point, 32 + 6)


def bucketed(rows: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each bucket of lines that a span touches."""
    return rows.withColumn("bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))


def is_visible(closure_: DataFrame, from_: Column, target: Column) -> Column:
    """A condition on rows of closure(): `target` is `from_` or around it."""
    return (closure_["scope_id"] == from_) & (closure_["ancestor_id"] == target)
