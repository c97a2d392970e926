"""Files and values of a workspace: which packages files belong to, which env files are theirs, and the values that they see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envatlas.functions import text
from envatlas.functions.settled import settled, with_all
from envatlas.operators import values


def under(path: Column, folder: Column) -> Column:
    """Whether a path is a folder or lies in it; the empty folder holds all."""
    return (folder == "") | (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def contexts(files: DataFrame, packages: DataFrame, root: str = "") -> DataFrame:
    """Adds package_root and workspace_root to files (path): of all packages (package_root) around a file the deepest one.

    Each path is exploded into the folders around it and joined by equality, so that no file meets a package that doesn't hold it.
    """
    steps = F.split(text.directory(F.col("path")), "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    near = files.select("path").distinct().select("path", F.explode(F.array_distinct(folders)).alias("package_root")).join(packages.select("package_root").distinct(), "package_root")
    best = near.groupBy("path").agg(F.max_by("package_root", F.length("package_root")).alias("package_root"))
    return files.join(best, "path", "left").withColumn("package_root", F.coalesce("package_root", F.lit(root))).withColumn("workspace_root", F.lit(root))


def relative(path: Column, root: str) -> Column:
    """The path below the root, or its last part where it lies elsewhere."""
    if not root:
        return path
    return F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))).otherwise(text.base_name(path))


def env_files(files: DataFrame, globs: list[str]) -> DataFrame:
    """Files (path) whose names match an env pattern, with file_rank, the place of the first such pattern: of two files of one folder the later one's overrides."""
    name = text.base_name(F.col("path"))
    rank = None
    for i, glob in enumerate(globs):
        hit = text.matches_any(name, [glob])
        rank = F.when(hit, i) if rank is None else rank.when(hit, i)
    return files.withColumn("file_rank", rank).where("file_rank is not null") if rank is not None else files.withColumn("file_rank", F.lit(0)).limit(0)


def package_files(env: DataFrame, package_root: str, workspace_root: str = "") -> DataFrame:
    """Env files (path) of a package, and those that stand directly in the workspace's root."""
    return env.where(under(F.col("path"), F.lit(package_root)) | (text.directory(F.col("path")) == workspace_root))


def active(env: DataFrame, patterns: list[str] | None) -> DataFrame:
    """Env files restricted to those whose name or path matches one of the patterns; no patterns, no restriction."""
    if not patterns:
        return env
    return env.where(text.matches_any(text.base_name(F.col("path")), patterns) | F.col("path").isin(*patterns))


def file_values(entries: DataFrame, env: DataFrame) -> DataFrame:
    """Value rows of dotenv entries (file_id, ord, key, value) of env files (file_id, path, file_rank): of a repeated key the last line counts."""
    good = entries.where("not is_comment and error_code is null") if "is_comment" in entries.columns else entries
    last = good.groupBy("file_id", "key").agg(F.max_by(F.struct("value", "ord"), "ord").alias("x"))
    return last.join(env.select("file_id", "path", "file_rank"), "file_id").select(F.lit("File").alias("source"), F.lit(None).cast("string").alias("provider"), F.col("path").alias("source_path"), "file_rank", "key", "x.value", "file_id", "x.ord")


def values_by_context(rows: DataFrame, roots: DataFrame, precedence: DataFrame, interpolate: bool = True) -> DataFrame:
    """(package_root, key, value, source, source_path): the values that the files of each package (package_root, workspace_root) see.

    File values count from env files directly in the package's root or the workspace's, the package's over the workspace's; all other sources count everywhere. Values
    are merged once a package, not once a file.
    """
    spots = roots.select("package_root", "workspace_root").distinct()
    own = spots.select("package_root", F.col("package_root").alias("folder"), F.lit(1).alias("near")).union(spots.where("package_root <> workspace_root").select("package_root", "workspace_root", F.lit(0)))
    filed = rows.where("source = 'File'").withColumn("folder", text.directory(F.col("source_path"))).join(own, "folder")
    # other sources' rows are joined to all packages only after the merge, as one default for each key
    others = rows.where("source <> 'File'")
    by_file = filed.join(F.broadcast(precedence), "source").groupBy("package_root", "key").agg(F.min(F.struct("source_rank", (-F.col("near")).alias("near"), (-F.col("file_rank")).alias("file"), "value", "source", "source_path")).alias("x"))  # one row a source
    by_rest = others.join(F.broadcast(precedence), "source").groupBy("key").agg(F.min(F.struct("source_rank", F.lit(0).alias("near"), (-F.col("file_rank")).alias("file"), "value", "source", "source_path")).alias("x"))
    everywhere = with_all(spots.select("package_root").distinct(), by_rest, "package_root").select("package_root", "key", "x")
    best = by_file.unionByName(everywhere).groupBy("package_root", "key").agg(F.min("x").alias("x")).select("package_root", "key", "x.value", "x.source", "x.source_path")
    if not interpolate:
        return best
    best = settled(best)
    return best.drop("value").join(values.interpolated_in(best.select("package_root", "key", "value")), ["package_root", "key"])


def value_for(files: DataFrame, by_context: DataFrame, key: str) -> DataFrame:
    """Adds value, source and source_path of one variable to files (package_root); null where it has none."""
    return files.join(by_context.where(F.col("key") == key).drop("key"), "package_root", "left")


def values_for(files: DataFrame, by_context: DataFrame) -> DataFrame:
    """All variables that each file (package_root) sees."""
    return files.join(by_context, "package_root")
