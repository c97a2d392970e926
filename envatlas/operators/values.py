"""Values of variables: precedence of sources, interpolation, and the tests on what is defined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envatlas.functions.settled import settled

MOST_DEPTH = 10


def merged(rows: DataFrame, precedence: DataFrame) -> DataFrame:
    """(key, value, source, source_path): of each key the value of the first source in precedence, then of the highest file rank.

    A source that `precedence` (source, source_rank) doesn't name is disabled.
    """
    best = rows.join(F.broadcast(precedence), "source").groupBy("key").agg(F.min(F.struct("source_rank", (-F.col("file_rank")).alias("file"), "value", "source", "source_path")).alias("x"))  # one row a source
    return best.select("key", "x.value", "x.source", "x.source_path")


def interpolated(values: DataFrame, enabled: bool = True, most: int = MOST_DEPTH) -> DataFrame:
    """(key, value) with ${NAME} replaced by NAME's value, nested up to `most` levels; an unknown name becomes empty.

    Each round splits values at their references, joins the names and puts the pieces together again; finished values take no part.
    """
    if not enabled:
        return values.select("key", "value")
    return interpolated_in(values.select(F.lit("").alias("package_root"), "key", "value"), most).select("key", "value")


def interpolated_in(values: DataFrame, most: int = MOST_DEPTH) -> DataFrame:
    """interpolated() of the values of many packages at once (package_root, key, value); names stand for values of the same package."""
    ref = r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}"
    base = values.select("package_root", F.col("key").alias("name"), F.col("value").alias("to"))
    now = settled(values.select("package_root", "key", "value"))
    for _ in range(most):
        open_ = now.where(F.col("value").rlike(ref))
        if not open_.limit(1).count():
            break
        parts = open_.select("package_root", "key", F.split("value", ref, -1).alias("texts"), F.regexp_extract_all("value", F.lit(ref), 1).alias("names"))
        each = parts.select("package_root", "key", F.posexplode("names").alias("i", "name")).join(base, ["package_root", "name"], "left")
        each = each.groupBy("package_root", "key").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("to", F.lit("")).alias("to")))).alias("tos"))
        filled = parts.join(each, ["package_root", "key"]).select("package_root", "key", F.array_join(F.zip_with("texts", "tos", lambda a, b: F.concat(a, F.coalesce(b["to"], F.lit("")))), "").alias("value"))
        now = settled(now.where(~F.col("value").rlike(ref) | F.col("value").isNull()).unionByName(filled))
    return now


def undefined(names: DataFrame, defined: DataFrame) -> DataFrame:
    """Rows of `names` whose name no defined key equals, case and all."""
    return names.join(defined.select(F.col("key").alias("name")).distinct(), "name", "left_anti")


def unused(defined: DataFrame, names: DataFrame) -> DataFrame:
    return defined.join(names.select(F.col("name").alias("key")).distinct(), "key", "left_anti")


def first_definition(entries: DataFrame) -> DataFrame:
    """Of each key the entry of the first file, then of the first line."""
    return entries.groupBy("key").agg(F.min(F.struct("file_rank", "ord", "file_id")).alias("x")).select("key", "x.file_id", "x.ord")


def example(names: DataFrame) -> DataFrame:
    """The lines of an example file, sorted: NAME= for each distinct name."""
    return names.select("name").distinct().select(F.concat("name", F.lit("=")).alias("line"), "name").orderBy("name").select("line")


def source_counts(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """(source, priority, n, enabled) for each kind of source; kinds: source, priority, enabled. Values in memory are not counted."""
    n = rows.where("source <> 'Memory'").groupBy("source").agg(F.count("*").alias("n"))
    return kinds.join(n, "source", "left").select("source", "priority", F.coalesce("n", F.lit(0)).alias("n"), "enabled")
