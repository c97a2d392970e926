"""Modules: where a specifier leads, and what an imported name stands for across files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envatlas.functions import text
from envatlas.functions.settled import settled

MOST_DEPTH = 10


def resolve_specifiers(imports: DataFrame, files: DataFrame, extensions: list[str]) -> DataFrame:
    """Adds target_id: the file that a relative specifier names, null for packages and misses.

    imports: path of the importing file and module_path. Tried in order: the path as it is, with each extension, as a folder with index and each extension.
    """
    base = text.normalised(F.concat_ws("/", text.directory(F.col("path")), F.col("module_path")))
    ways = [("", "")] + [("", "." + e) for e in extensions] + [("/index", "." + e) for e in extensions]
    tries = imports.select("path", "module_path", base.alias("base")).distinct().where(text.is_relative(F.col("module_path")) & F.col("base").isNotNull())
    tries = tries.select("path", "module_path", F.posexplode(F.array(*[F.concat("base", F.lit(a + b)) for a, b in ways])).alias("way", "candidate"))
    hits = tries.join(files.select(F.col("path").alias("candidate"), F.col("file_id").alias("target_id")), "candidate")
    best = hits.groupBy("path", "module_path").agg(F.min_by("target_id", "way").alias("target_id"))
    return imports.join(best, ["path", "module_path"], "left")


def last_exports(exports: DataFrame) -> DataFrame:
    """Of exports of one name in a file the last one counts."""
    best = exports.groupBy("file_id", "exported_name").agg(F.max("ord").alias("ord"))
    return exports.join(best, ["file_id", "exported_name", "ord"], "left_semi")


def resolve_exports(exports: DataFrame, wildcards: DataFrame, most: int = MOST_DEPTH) -> DataFrame:
    """(file_id, exported_name, res_kind, res_name, defining_file, depth) for each name that a file exports, itself or through others.

    exports: file_id, exported_name, res_kind (EnvVar, EnvObject, ReExport, LocalChain, Unknown), res_name, target_file,
    orig_name. wildcards: file_id, ord, target_file. A file's own export shadows its wildcards, earlier wildcards shadow later ones; a cycle
    leads nowhere. Facts flow from defining files to their importers, a round a hop, and never back to a file they passed.
    """
    own = exports.select("file_id", "exported_name").distinct()
    known = exports.where(F.col("res_kind").isin("EnvVar", "EnvObject")).select("file_id", "exported_name", "res_kind", "res_name", F.col("file_id").alias("defining_file"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("way"))
    links = exports.where("res_kind = 'ReExport'").select("file_id", "exported_name", F.col("target_file").alias("t"), F.col("orig_name").alias("n"))
    facts = new = settled(known.withColumn("seen", F.array("file_id")))
    for depth in range(1, most):
        through = new.select(F.col("file_id").alias("t"), F.col("exported_name").alias("n"), "res_kind", "res_name", "defining_file", "way", "seen")
        named = through.join(links, ["t", "n"]).select("file_id", "exported_name", "res_kind", "res_name", "defining_file", F.lit(depth).alias("depth"), "way", "seen")
        wild = through.join(wildcards.select("file_id", "ord", F.col("target_file").alias("t")), "t").select("file_id", F.col("n").alias("exported_name"), "res_kind", "res_name", "defining_file", F.lit(depth).alias("depth"), F.concat(F.array(F.col("ord").cast("int")), "way").alias("way"), "seen")
        wild = wild.where("exported_name <> 'default'").join(own, ["file_id", "exported_name"], "left_anti")
        onward = named.unionByName(wild).where(~F.array_contains("seen", F.col("file_id")))
        # of the ways to one definition the first counts, so that diamonds of re-exports don't multiply
        best = onward.groupBy("file_id", "exported_name", "defining_file", "res_kind", "res_name").agg(F.min(F.struct("way", "depth", "seen")).alias("x"))
        new = settled(best.select("file_id", "exported_name", "res_kind", "res_name", "defining_file", "x.depth", "x.way", F.concat("x.seen", F.array("file_id")).alias("seen")))
        if not new.limit(1).count():
            break
        facts = facts.unionByName(new)
    best = facts.groupBy("file_id", "exported_name").agg(F.min(F.struct("way", "depth", "res_kind", "res_name", "defining_file")).alias("x"))
    return best.select("file_id", "exported_name", "x.res_kind", "x.res_name", "x.defining_file", "x.depth")
