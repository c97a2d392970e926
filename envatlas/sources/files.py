"""Finding the files of a workspace: a Python data source that walks folders, hidden files included, honouring ignore rules."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from envatlas.sources.languages import BY_EXTENSION

ENV_GLOBS = (".env", ".env.*", "*.env")


def ignored(path: str, rules: list[str]) -> bool:
    """Whether ignore rules (later ones win, ! re-admits) exclude a path relative to their folder."""
    out = False
    for rule in rules:
        no, rule = rule.startswith("!"), rule.lstrip("!").rstrip("/")
        parts = path.split("/")
        hit = fnmatch.fnmatch(path, rule.lstrip("/")) if "/" in rule else any(fnmatch.fnmatch(p, rule) for p in parts)
        hit = hit or any(fnmatch.fnmatch("/".join(parts[: i + 1]), rule.lstrip("/")) for i in range(len(parts)) if "/" in rule)
        out = (not no) if hit else out
    return out


def rules_of(path: str) -> list[str]:
    """The ignore rules in a file, in order; a file that can't be read has none."""
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return [r for r in map(str.strip, f) if r and not r.startswith("#")]
    except OSError:
        return []


def global_ignore() -> str:
    """Where the user's own ignore rules stand by default."""
    return os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git", "ignore")


def walk(root: str, globs: tuple[str, ...] = ENV_GLOBS, user_rules: str | None = None) -> Iterator[str]:
    """Paths relative to `root` of files in a known language or matching an env glob; the user's rules, the repository's own excludes and each folder's apply."""
    rules: list[str] = rules_of(user_rules or global_ignore()) + rules_of(os.path.join(root, ".git", "info", "exclude"))
    for folder, names, found in os.walk(root):
        rel = os.path.relpath(folder, root)
        rel = "" if rel == "." else rel + "/"
        if ".gitignore" in found:
            rules += [r if not rel else (("!" if r.startswith("!") else "") + rel + r.lstrip("!/")) for r in rules_of(os.path.join(folder, ".gitignore"))]
        names[:] = sorted(n for n in names if n != ".git" and not ignored(rel + n, rules))
        for name in sorted(found):
            known = name.rpartition(".")[2] in BY_EXTENSION or any(fnmatch.fnmatch(name, g) for g in globs)
            if known and not ignored(rel + name, rules):
                yield rel + name


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, root: str, globs: tuple[str, ...], size: int):
        self.root, self.globs, self.size = root, globs, size

    def partitions(self) -> list[InputPartition]:
        paths = list(walk(self.root, self.globs))
        return [_Part(paths[i : i + self.size]) for i in range(0, len(paths), self.size)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        import datetime

        for path in partition.paths:
            full = os.path.join(self.root, path)
            with open(full, encoding="utf-8", errors="replace") as f:
                yield path, os.path.basename(path), any(fnmatch.fnmatch(os.path.basename(path), g) for g in self.globs), f.read(), datetime.datetime.fromtimestamp(os.stat(full).st_mtime)


class Workspace(DataSource):
    """spark.read.format("workspace").load(root): path, name, is_env, content, mtime. `root` must be a folder that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return "path string, name string, is_env boolean, content string, mtime timestamp"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], tuple(self.options.get("globs", ",".join(ENV_GLOBS)).split(",")), int(self.options.get("files_per_task", "500")))


def workspace(spark: SparkSession, root: str, globs: tuple[str, ...] = ENV_GLOBS) -> DataFrame:
    spark.dataSource.register(Workspace)
    return spark.read.format("workspace").option("globs", ",".join(globs)).load(root)


VALUES = "source string, provider string, source_path string, file_rank int, key string, value string"


def shell(spark: SparkSession, variables: dict[str, str] | None = None) -> DataFrame:
    """The process environment as value rows."""
    pairs = sorted((variables if variables is not None else dict(os.environ)).items())
    return spark.createDataFrame([("Shell", None, None, 0, k, v) for k, v in pairs], VALUES)


def memory(spark: SparkSession, variables: dict[str, str]) -> DataFrame:
    """Values that only the session holds, as value rows."""
    return spark.createDataFrame([("Memory", None, None, 0, k, v) for k, v in sorted(variables.items())], VALUES)


def watched(globs: tuple[str, ...] = ENV_GLOBS, config: str = "envatlas.toml") -> list[tuple[str, str]]:
    """(glob, events) that a watcher registers for: the config file, env files, and code files, whose changes editors tell themselves."""
    every = "create,change,delete"
    return [(f"**/{config}", every), *((f"**/{g}", every) for g in globs), *((f"**/*.{e}", "create,delete") for e in sorted(BY_EXTENSION))]
