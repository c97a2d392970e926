"""The index as tables under a shared folder: saved once, read by later sessions, and kept up to date by rewriting only the buckets of changed files.

Kept are the tables that each file makes alone: its text, facts, scopes, symbols, usages, entries, locations and exports. What joins files (values, links between modules) is
worked out from them when asked for, so that a change of one file costs one bucket of each table and never the extraction of another file. Every table is a Parquet folder
partitioned by `bucket`, a hash of file_id; an update replaces partitions by Spark's dynamic overwrite. `classified`, which holds mtimes, is written last: an update that was cut off
leaves its files stale, and the next refresh does them again with the same outcome. One writer at a time; a reader loads the index anew after an update.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from envatlas.functions.settled import settled
from envatlas.operators.graph import Graph
from envatlas.plans.workspace import Index
from envatlas.streaming import index as streaming

BUCKETS = 256
#: In the order of writing.
TABLES = ("facts", "closure", "symbols", "usages", "entries", "locations", "exports", "classified")


def _tables(index: Index) -> dict[str, DataFrame]:
    g = index.graph
    return {"facts": g.facts, "closure": g.closure, "symbols": g.symbols, "usages": g.usages, "entries": index.entries, "locations": index.locations, "exports": index.exports, "classified": index.classified}


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int")


def _put(rows: DataFrame, buckets: list[int], path: str, mode: str) -> None:
    """Writes rows (with bucket) over the partitions of `buckets`. A row without file_id stands in each, so that one whose files all went is replaced too; AQE splits large buckets and joins small ones."""
    marks = rows.sparkSession.createDataFrame([(b,) for b in buckets], "bucket int")
    out = rows.unionByName(marks, allowMissingColumns=True).hint("rebalance", "bucket")
    out.write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", mode).parquet(path)


def save(index: Index, path: str, buckets: int = BUCKETS) -> None:
    """Writes the index under `path`, over one that stands there. A bucket should hold at most some GB of text: updates rewrite whole buckets."""
    spark = index.files.sparkSession
    for name, rows in _tables(index).items():
        _put(rows.where("file_id is not null").withColumn("bucket", _bucket(buckets)), list(range(buckets)), f"{path}/{name}", "static")
    about = spark.createDataFrame([(buckets, list(index.globs), index.use_imports)], "buckets int, globs array<string>, use_imports boolean")
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def _stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").where("file_id is not null")


def load(spark: SparkSession, path: str, **options) -> Index:
    """The index that stands under `path`: nothing is extracted again. options: precedence, other_values, interpolate."""
    about = spark.read.parquet(f"{path}/about").first()
    t = {name: _stored(spark, path, name).drop("bucket") for name in TABLES}
    index = Index(t["classified"].drop("lang", "is_env"), list(about.globs), use_imports=about.use_imports, **options)
    index.classified, index.entries, index.locations, index.exports = t["classified"], t["entries"], t["locations"], t["exports"]
    index.graph = Graph(t["facts"], t["closure"], t["symbols"], t["usages"])
    return index


def update(spark: SparkSession, path: str, fresh: DataFrame, gone: DataFrame) -> list[int]:
    """Puts the files of `fresh` (file_id, path, content, mtime; one row a file) in place of what is stored of them, takes those of `gone` (file_id) out, and returns the buckets that were rewritten.

    Only the fresh files are extracted. To run it again changes nothing more.
    """
    about = spark.read.parquet(f"{path}/about").first()
    fresh = settled(fresh.select("file_id", "path", "content", "mtime").where("file_id is not null"))
    touched = settled(fresh.select("file_id").union(gone.select("file_id").where("file_id is not null")).distinct())
    buckets = sorted(r.bucket for r in touched.select(_bucket(about.buckets).alias("bucket")).distinct().collect())  # as many numbers as there are buckets at most
    if buckets:
        new = _tables(Index(fresh, list(about.globs), use_imports=about.use_imports))
        for name in TABLES:
            kept = _stored(spark, path, name).where(F.col("bucket").isin(buckets)).join(touched, "file_id", "left_anti")
            _put(kept.unionByName(new[name].withColumn("bucket", _bucket(about.buckets))), buckets, f"{path}/{name}", "dynamic")
    return buckets


def refresh(spark: SparkSession, path: str, files: DataFrame) -> list[int]:
    """Brings the stored index to the state of the folder: `files` (file_id, path, content, mtime) are all that there are now. Files with a later mtime and new ones are read, those that are missing go."""
    known = _stored(spark, path, "classified").select("file_id", "mtime")
    late = streaming.stale(files.select("file_id", "mtime"), known).select("file_id").distinct()
    return update(spark, path, files.join(late, "file_id", "left_semi"), known.join(files.select("file_id"), "file_id", "left_anti"))


def apply_edits(spark: SparkSession, path: str, edits: DataFrame) -> list[int]:
    """Applies edits (path, ts, op, version, content) of any number of documents: of each its last one counts. A `close` or `delete` takes the document out.

    Results of a version that is not later than the stored one are dropped. A document that was taken out leaves no trace, so that an edit that is later than its closing in arrival only brings it back.
    """
    last = edits.where("path is not null").groupBy("path").agg(F.max_by(F.struct("op", "content", F.col("ts").alias("mtime")), F.struct("version", "ts")).alias("x")).select(F.xxhash64("path").alias("file_id"), "path", "x.*")
    last = settled(last)
    known = _stored(spark, path, "classified").select("file_id", "mtime")
    closes = F.col("op").isin("close", "delete")
    gone = last.where(closes).join(known.withColumnRenamed("mtime", "indexed"), "file_id").where("indexed <= mtime")
    return update(spark, path, streaming.stale(last.where(~closes), known), gone)


def follow(edits: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Follows a stream of edits and keeps the stored index up to date. A batch that runs again finds nothing that is stale."""
    out = edits.writeStream.foreachBatch(lambda batch, _: apply_edits(batch.sparkSession, path, batch)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
