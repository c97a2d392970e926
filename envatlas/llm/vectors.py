"""Which rows of a vector table take part: not null, of the table's usual length, finite, not zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is not null, holds only finite numbers and is not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def finite(vector: Column) -> Column:
    """Whether a vector is not null and holds only finite numbers; zero vectors and empty ones do."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def usual_length(df: DataFrame, vector: str) -> int:
    """The length of most usable vectors (the shortest on ties); 0 if there is none."""
    row = df.groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return row.n if row else 0
