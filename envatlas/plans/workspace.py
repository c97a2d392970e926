"""The batch index: files in, and all that is known of them out, in one plan.

Code files are extracted, made into graphs and linked through their exports; env files are parsed into entries and values; locations are inverted.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envatlas.functions import text
from envatlas.functions.settled import settled
from envatlas.operators import endpoints, graph, locations, modules, positions, values, workspace
from envatlas.sources import dotenv, extract, files as file_source
from envatlas.sources.languages import BY_EXTENSION

EXTENSIONS = ["js", "jsx", "mjs", "cjs", "ts", "mts", "cts", "tsx"]


@dataclass
class Index:
    """files: file_id, path, content, mtime. Each table is made when first asked for and kept."""

    files: DataFrame
    globs: list[str] = field(default_factory=lambda: list(file_source.ENV_GLOBS))
    precedence: tuple[str, ...] = ("Shell", "File")
    other_values: DataFrame | None = None
    use_imports: bool = False
    interpolate: bool = True

    @cached_property
    def classified(self) -> DataFrame:
        is_env = text.matches_any(text.base_name(F.col("path")), self.globs)
        return settled(extract.with_language(self.files).withColumn("is_env", is_env).withColumn("lang", F.when(~F.col("is_env"), F.col("lang"))))

    @cached_property
    def graph(self) -> graph.Graph:
        return graph.analysed(self.classified.where("lang is not null").select("file_id", "lang", "content"), self.use_imports)

    @cached_property
    def env(self) -> DataFrame:
        return workspace.env_files(self.classified.where("is_env"), self.globs)

    @cached_property
    def entries(self) -> DataFrame:
        return settled(dotenv.entries(self.env.select("file_id", "content")))

    @cached_property
    def values(self) -> DataFrame:
        """(key, value, source, source_path) after precedence and interpolation."""
        spark = self.files.sparkSession
        rank = spark.createDataFrame([(s, i) for i, s in enumerate(self.precedence)], "source string, source_rank int")
        rows = workspace.file_values(self.entries, self.env).select("source", "source_path", "file_rank", "key", "value")
        if self.other_values is not None:
            rows = rows.unionByName(self.other_values.select("source", "source_path", "file_rank", "key", "value"))
        merged = settled(values.merged(rows, rank))
        return merged.drop("value").join(values.interpolated(merged, self.interpolate), "key")

    @cached_property
    def locations(self) -> DataFrame:
        return settled(self.graph.locations())

    @cached_property
    def definitions(self) -> DataFrame:
        return settled(endpoints.definitions(self.entries, self.env))

    @cached_property
    def env_to_files(self) -> DataFrame:
        """(name, file_id): variables that code files use or env files define; property accesses through an alias alone do not count."""
        used = self.graph.all_env_vars().select("name", "file_id")
        defined = self.entries.where("not is_comment and error_code is null and key <> ''").select(F.col("key").alias("name"), "file_id")
        return settled(used.union(defined).distinct())

    @cached_property
    def exports(self) -> DataFrame:
        return settled(graph.exports(self.graph))

    @cached_property
    def resolved_exports(self) -> DataFrame:
        linked, wild = graph.linked_exports(self.exports, graph.wildcards(self.graph), self.classified, EXTENSIONS)
        return settled(modules.resolve_exports(linked.select("file_id", "exported_name", "res_kind", "res_name", "target_file", "orig_name"), wild))

    @cached_property
    def imported(self) -> DataFrame:
        return settled(graph.imported(graph.import_context(self.graph.facts), self.classified, self.resolved_exports, EXTENSIONS))

    @cached_property
    def targets(self) -> DataFrame:
        return settled(positions.targets(self.graph, self.imported))

    def file_index(self) -> DataFrame:
        """(file_id, path, mtime, is_env, env_vars): one row a file with the names of its variables, sorted."""
        names = self.env_to_files.groupBy("file_id").agg(F.sort_array(F.collect_set("name")).alias("env_vars"))
        return self.classified.select("file_id", "path", "mtime", "is_env").join(names, "file_id", "left").withColumn("env_vars", F.coalesce("env_vars", F.array().cast("array<string>")))

    def env_export_to_files(self) -> DataFrame:
        return graph.exported_env_vars(self.exports).select("name", "file_id")

    def all_env_vars(self) -> DataFrame:
        return self.env_to_files.select("name").distinct()

    def all_exported_env_vars(self) -> DataFrame:
        return self.env_export_to_files().select("name").distinct()

    def stats(self) -> DataFrame:
        return locations.stats(self.classified, self.env_to_files)

    # Endpoints
    def hover(self, probes: DataFrame, enabled: bool = True) -> DataFrame:
        return endpoints.hover(positions.at(probes, self.targets).where("hit is not null"), self.values, enabled)

    def definition(self, probes: DataFrame) -> DataFrame:
        return endpoints.definition(positions.at(probes, self.targets, variables_only=True).where("variable is not null"), self.definitions, self.values)

    def references(self, names: DataFrame, with_definition: bool = True) -> DataFrame:
        return endpoints.references(names, self.locations, self.definitions if with_definition else None)

    def rename(self, names: DataFrame) -> DataFrame:
        return endpoints.rename(names, self.locations, self.definitions)

    def prepare_rename(self, probes: DataFrame) -> DataFrame:
        return endpoints.prepare_rename(probes, self.targets, self.entries)

    def symbols(self, query: str) -> DataFrame:
        return endpoints.workspace_symbols(query, self.locations, self.definitions, self.env_to_files)

    def diagnostics(self, enabled: bool = True) -> DataFrame:
        """Of code and of env files."""
        code = endpoints.diagnostics(self.graph, self.values, enabled)
        env = endpoints.env_diagnostics(self.entries).withColumn("message", F.col("code"))
        return code.unionByName(env if enabled else env.limit(0))

    def refreshed(self, open_: DataFrame, enabled: bool = True) -> DataFrame:
        """(file_id, diagnostics): what each open document (file_id) is sent after a change that may touch all of them; an empty list where there is nothing."""
        documents = open_.select("file_id").distinct()
        found = self.diagnostics(enabled).join(documents, "file_id", "left_semi")
        rows = found.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("sl", "sc", "el", "ec", "severity", "code", "message"))).alias("found"))
        empty = F.array().cast(rows.schema["found"].dataType)
        return documents.join(rows, "file_id", "left").select("file_id", F.coalesce("found", empty).alias("diagnostics"))

    def metrics(self) -> DataFrame:
        """One row: total_files, env_files, total_env_vars and exported_env_vars."""
        return self.stats().crossJoin(self.all_exported_env_vars().agg(F.count("*").alias("exported_env_vars")))  # one row by one row

    def inlay_hints(self, **options) -> DataFrame:
        return endpoints.inlay_hints(self.locations, self.values, known=self.graph.all_env_vars(), **options)

    def completion(self, probes: DataFrame, strict: bool = True, enabled: bool = True) -> DataFrame:
        contents = self.classified.select("file_id", "lang", "content")
        objects = {spec.name: spec.objects for spec in BY_EXTENSION.values()}
        asked = extract.by_cursor(probes, contents).join(contents.select("file_id", "lang"), "file_id")
        return endpoints.completion(asked, self.graph, self.values, objects, self.imported, strict, enabled)


def index_workspace(spark, root: str, globs: tuple[str, ...] = file_source.ENV_GLOBS, **options) -> Index:
    """The index of a folder that all executors see; files are numbered by their path's hash."""
    found = file_source.workspace(spark, root, globs).withColumn("file_id", F.xxhash64("path"))
    return Index(found, list(globs), **options)
