"""Incremental upkeep of the index: debounced edits, staleness, dirty dependents, and streams that drive them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

QUIET = "300 milliseconds"


def debounced(events: DataFrame, quiet: str = QUIET, key: str = "uri", ts: str = "ts", version: str = "version", value: str = "content") -> DataFrame:
    """One row for each burst of edits of a document with less than `quiet` between them: the latest version's content. Batch or stream (with a watermark)."""
    burst = events.groupBy(F.col(key), F.session_window(F.col(ts), quiet).alias("w")).agg(F.max_by(value, version).alias(value), F.max(version).alias(version), F.count("*").alias("edits"))
    return burst.select(key, F.col("w.start").alias("first_edit"), (F.col("w.end") - F.expr(f"INTERVAL {quiet}")).alias("last_edit"), version, value, "edits")


def edit_ranges(edits: DataFrame, key: str = "uri") -> DataFrame:
    """The range around all edits of a document."""
    return edits.groupBy(key).agg(F.min(F.struct("sl", "sc")).alias("a"), F.max(F.struct("el", "ec")).alias("b")).select(key, "a.sl", "a.sc", "b.el", "b.ec")


def latest(events: DataFrame, key: str = "uri") -> DataFrame:
    """The state after all events: of each document its last event, unless that closes or deletes it."""
    last = events.groupBy(key).agg(F.max_by(F.struct("op", "content", "version"), F.struct("version", "ts")).alias("x"))
    return last.where(~F.col("x.op").isin("close", "delete")).select(key, "x.version", "x.content")


def stale(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files whose mtime is later than the indexed one, or that the index lacks."""
    return files.join(index.select("file_id", F.col("mtime").alias("indexed")), "file_id", "left").where(F.coalesce(F.col("mtime") > F.col("indexed"), F.lit(True))).drop("indexed")


def dirty(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Direct importers of the changed files. edges: file_id imports target_id."""
    return edges.join(changed.select(F.col("file_id").alias("target_id")).distinct(), "target_id", "left_semi").select("file_id").distinct()


def without_files(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The dependency graph without the files and the edges at either of their ends."""
    g = gone.select("file_id").distinct()
    return edges.join(g, "file_id", "left_anti").join(g.withColumnRenamed("file_id", "target_id"), "target_id", "left_anti").select("file_id", "target_id")


def kept_cache(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """Cached resolutions whose importer and target are unchanged."""
    return without_files(cache.withColumnRenamed("importer", "file_id"), changed).withColumnRenamed("file_id", "importer")


def merged_graph(old: DataFrame, removed: DataFrame, new: DataFrame) -> DataFrame:
    """Symbols of the old graph outside the removed ranges, and the new ones under ids after the old."""
    hit = old.join(removed.select("file_id", F.col("start").alias("rs"), F.col("end").alias("re")), "file_id").where("end > rs and re > start").select("file_id", "symbol_id").distinct()
    stay = old.join(hit, ["file_id", "symbol_id"], "left_anti")
    top = old.groupBy("file_id").agg(F.max("symbol_id").alias("top"))
    fresh = new.join(top, "file_id", "left").withColumn("symbol_id", F.coalesce("top", F.lit(0)) + F.row_number().over(Window.partitionBy("file_id").orderBy("start", "name"))).drop("top")
    return stay.unionByName(fresh)


def maintain(edits: DataFrame, path: str, index: Callable[[DataFrame], DataFrame], checkpoint: str, watermark: str = "10 seconds", available_now: bool = True) -> StreamingQuery:
    """Follows a stream of edits and appends the facts of each debounced version under `path`, by batch; read them with current()."""
    bursts = debounced(edits.withWatermark("ts", watermark))

    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch that runs again overwrites its own folder
        index(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    out = bursts.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def current(facts: DataFrame, key: str = "uri") -> DataFrame:
    """Of what maintain() wrote, the rows of each document's latest version."""
    top = facts.groupBy(key).agg(F.max("version").alias("version"))
    return facts.join(top, [key, "version"], "left_semi")


# The dependency graph: edges (file_id imports target_id), and the files that changes make dirty
def replaced_edges(edges: DataFrame, files: DataFrame, new: DataFrame) -> DataFrame:
    """The graph after the files (file_id) got new imports: their old edges go, wherever others point stays."""
    return edges.join(files.select("file_id").distinct(), "file_id", "left_anti").unionByName(new.select("file_id", "target_id")).distinct()


def dependents(edges: DataFrame) -> DataFrame:
    """The graph the other way: target_id is imported by file_id."""
    return edges.select(F.col("target_id").alias("file_id"), F.col("file_id").alias("dependent_id")).distinct()


def dirty_after(dirty_: DataFrame, edges: DataFrame, changed: DataFrame, cleaned: DataFrame | None = None) -> DataFrame:
    """The dirty files after some changed or went: their direct importers become dirty, those analysed anew (cleaned) do not stay so."""
    now = dirty_.select("file_id").union(dirty(changed, edges)).distinct()
    return now.join(cleaned.select("file_id").distinct(), "file_id", "left_anti") if cleaned is not None else now


def removed(edges: DataFrame, dirty_: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, dirty) after files were deleted: edges at either end go, and the files that imported them become dirty; the deleted ones are not."""
    left = dirty_after(dirty_, edges, gone).join(gone.select("file_id").distinct(), "file_id", "left_anti")
    return without_files(edges, gone), left


# Incremental graphs
def is_large_edit(edit_lines, document_lines):
    """Whether an edit covers more than half of a document, so that all of it is analysed anew."""
    return edit_lines * 2 > document_lines


def without_ranges(symbols: DataFrame, usages: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and usages outside the ranges (file_id, start, end); usages of symbols that went go too. An id has one row in a file.

    Ranges, the fewer rows, are hashed by file, so that symbols dealt by file pass without being shuffled or sorted.
    """
    cut = ranges.select(F.col("file_id").alias("rf"), F.col("start").alias("rs"), F.col("end").alias("re")).hint("shuffle_hash")
    hit = symbols.join(ranges.select("file_id", F.col("start").alias("rs"), F.col("end").alias("re")), "file_id").where("end > rs and re > start").select("file_id", "symbol_id").distinct()
    inside = usages.join(ranges.select("file_id", F.col("start").alias("rs"), F.col("end").alias("re")), "file_id").where("end > rs and re > start").select("file_id", "usage_id").distinct()
    return symbols.join(cut, F.expr("file_id = rf and end > rs and re > start"), "left_anti"), usages.join(hit, ["file_id", "symbol_id"], "left_anti").join(inside, ["file_id", "usage_id"], "left_anti")


# Open documents and watched files
def open_documents(events: DataFrame, key: str = "uri") -> DataFrame:
    """Documents that are open after all events: opened or changed, and not closed since; the text is that of the latest version."""
    return latest(events.where(F.col("op").isin("open", "change", "close", "delete")), key)


def watched_changes(events: DataFrame, is_env, config_file: str = "envatlas.toml", key: str = "path") -> DataFrame:
    """(path, action) of file events (path, type, ts), the last one of a file: reload the config, refresh values, index again, or remove."""
    last = events.groupBy(key).agg(F.max_by("type", "ts").alias("type"))
    name = F.element_at(F.split(key, "/"), -1)
    action = F.when(name == config_file, "reload").when(F.col("type") == "delete", "remove").when(is_env(F.col(key)), "refresh").otherwise("index")
    return last.select(key, action.alias("action"))


def after_changes(index: DataFrame, actions: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """The index rows after watched changes: rows of removed and changed files go, those of `fresh` come."""
    touched = actions.where(F.col("action").isin("remove", "index", "refresh")).select(key).distinct()
    return index.join(touched, key, "left_anti").unionByName(fresh.join(actions.where("action <> 'remove'").select(key).distinct(), key, "left_semi"))


def publish(edits: DataFrame, path: str, diagnose: Callable[[DataFrame], DataFrame], checkpoint: str, watermark: str = "10 seconds", available_now: bool = True) -> StreamingQuery:
    """Follows a stream of edits and writes the diagnostics of each debounced version under `path`, and a row `published` for each document, so that an empty list is told too."""
    bursts = debounced(edits.withWatermark("ts", watermark))

    def write(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("uri").agg(F.max_by(F.struct("version", "content"), "version").alias("x")).select("uri", "x.*")
        found = diagnose(last)
        told = last.select("uri", "version").join(found.groupBy("uri").agg(F.count("*").alias("n")), "uri", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        # a batch that runs again overwrites its own folders
        found.write.mode("overwrite").parquet(f"{path}/diagnostics/batch={batch_id}")
        told.write.mode("overwrite").parquet(f"{path}/published/batch={batch_id}")

    out = bursts.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def notifications(actions: DataFrame, key: str = "path") -> DataFrame:
    """(kind, message) of what clients are told after watched changes: a request to refresh hints where values changed, and a log line a file."""
    log = actions.select(F.lit("log").alias("kind"), F.concat(F.col("action"), F.lit(": "), F.col(key)).alias("message"))
    return log.unionByName(actions.where(F.col("action").isin("refresh", "reload")).select(F.lit("refresh-hints").alias("kind"), F.lit("").alias("message")).distinct())


def heartbeat(query: StreamingQuery) -> dict:
    """What a running stream last did: rows, rows a second and the state's size."""
    p = query.lastProgress or {}
    return {"active": query.isActive, "batch": p.get("batchId"), "rows": p.get("numInputRows", 0), "rows_per_second": p.get("processedRowsPerSecond", 0.0), "state_rows": sum(o.get("numRowsTotal", 0) for o in p.get("stateOperators", []))}


class Cancellable:
    """Jobs under a tag that can be stopped from elsewhere, and streams that stop with them."""

    def __init__(self, spark, tag: str):
        self.spark, self.tag, self.streams = spark, tag, []

    def __enter__(self) -> Cancellable:
        self.spark.sparkContext.addJobTag(self.tag)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext.removeJobTag(self.tag)

    def follow(self, query: StreamingQuery) -> StreamingQuery:
        self.streams.append(query)
        return query

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
        for q in self.streams:
            if q.isActive:
                q.stop()
