"""Where variables stand: an ordered union of location kinds, one location a range, and what is counted of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHASES = ("DirectReference", "BindingDeclaration", "BindingUsage", "PropertyAccess")


def locations(refs: DataFrame, declarations: DataFrame, uses: DataFrame) -> DataFrame:
    """(file_id, name, kind, sl, sc, el, ec): of all candidates for a range the first phase's first one stays.

    Each input has file_id, name, kind, seq and a range. Only the least (phase, seq) a range is kept, so the work is one aggregation.
    """
    each = [d.select("file_id", "name", "kind", "seq", "sl", "sc", "el", "ec", F.lit(k).alias("phase")) for k, d in enumerate((refs, declarations, uses))]
    rows = each[0].unionByName(each[1]).unionByName(each[2])
    best = rows.groupBy("file_id", "sl", "sc", "el", "ec").agg(F.min(F.struct("phase", "seq", "name", "kind")).alias("x"))
    return best.select("file_id", "x.name", "x.kind", "sl", "sc", "el", "ec")


def files_by_variable(locations_: DataFrame) -> DataFrame:
    """The inverted index: a row for each variable and file, not a list, so that no variable's files meet in one row."""
    return locations_.select("name", "file_id").distinct()


def stats(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: total_files, env_files, total_env_vars."""
    f = files.agg(F.count("*").alias("total_files"), F.count_if("is_env").alias("env_files"))
    return f.crossJoin(pairs.agg(F.count_distinct("name").alias("total_env_vars")))  # one row by one row


def progress(indexed, total):
    """Percent done, 100 where there is nothing to do."""
    return F.when(total == 0, F.lit(100)).otherwise(F.least(F.lit(100), F.floor(indexed * 100 / total))).cast("int")


def capped(rows: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    """At most `most` rows a group, the first in order."""
    from pyspark.sql import Window

    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rn_") <= most).drop("rn_")
