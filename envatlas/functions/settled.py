"""Tables that cut the lineage of iterative operators: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Only a local session may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", root := "file://" + tempfile.mkdtemp(prefix="shared-"))
    return f"{root}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and written under spark.checkpoint.dir."""
    path = shared_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_all(left: DataFrame, right: DataFrame, key: str, spread: int = 64) -> DataFrame:
    """Every row of `left` with every row of `right`, where that is the result's own size, as an equi-join over `spread` shares of `left` by `key`.

    `right` is copied into each share, so no task gets all rows, and neither side is broadcast.
    """
    a = left.withColumn("share_", F.pmod(F.xxhash64(key), F.lit(spread)).cast("int"))
    b = right.withColumn("share_", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return a.join(b, "share_").drop("share_")
