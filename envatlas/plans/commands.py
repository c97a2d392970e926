"""Commands on a session's workspace: lists of variables, files, sources and providers, and settings that change what later answers hold.

Answers are DataFrames; settings answer one row with what now holds. A command that cannot be carried out raises CommandError with the reason.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envatlas.functions import text
from envatlas.operators import values, workspace
from envatlas.plans.workspace import Index
from envatlas.sources import config as config_
from envatlas.sources.providers import Registry

PRIORITIES = (("Shell", 100), ("File", 50), ("Remote", 25))
#: After these, diagnostics and hints of all open documents are asked for anew.
REFRESHING = ("file.setActive", "source.setPrecedence", "workspace.setRoot", "interpolation.set")


class CommandError(ValueError):
    """Why a command could not be carried out."""


@dataclass
class Session:
    """What commands read and set. `files`: file_id, path, content, mtime; `values`: value rows of sources other than files."""

    spark: SparkSession
    files: DataFrame
    values: DataFrame | None = None
    root: str = ""
    config: dict = field(default_factory=config_.load)
    active: list[str] | None = None
    providers: Registry = field(default_factory=Registry)
    packages: DataFrame | None = None

    @property
    def precedence(self) -> list[str]:
        return self.config["resolution"]["precedence"]

    def index(self) -> Index:
        rows = self.values
        if self.providers.signed_in:
            remote = self.providers.values(self.spark)
            rows = remote if rows is None else rows.unionByName(remote)
        kept = self.files
        if self.active:
            name = text.base_name(F.col("path"))
            kept = kept.where(~text.matches_any(name, self.config["workspace"]["env_files"]) | text.matches_any(name, self.active) | F.col("path").isin(*self.active))
        return Index(kept, self.config["workspace"]["env_files"], tuple(self.precedence), rows, interpolate=self.config["interpolation"]["enabled"])

    def run(self, command: str, *arguments) -> DataFrame:
        if command not in COMMANDS:
            raise CommandError(f"Unknown command: {command}")
        try:
            return COMMANDS[command](self, *arguments)
        except ValueError as e:
            raise e if isinstance(e, CommandError) else CommandError(str(e)) from e

    def said(self, **row) -> DataFrame:
        types = {bool: "boolean", int: "int", str: "string", list: "array<string>"}
        return self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {types[type(v)]}" for k, v in row.items()))


def set_active(s: Session, *patterns: str) -> DataFrame:
    """Restricts the env files to those that match; without patterns all are active again."""
    s.active = list(patterns) or None
    return s.said(success=True, patterns=s.active or [])


def list_variables(s: Session, path: str | None = None) -> DataFrame:
    """(name, value, source) of all variables, of a file's package if a path is given."""
    index = s.index()
    if path is None or s.packages is None:
        return listed(index.values, s.root)
    rank = s.spark.createDataFrame([(x, i) for i, x in enumerate(s.precedence)], "source string, source_rank int")
    rows = workspace.file_values(index.entries, index.env).select("source", "source_path", "file_rank", "key", "value")
    if s.values is not None:
        rows = rows.unionByName(s.values.select("source", "source_path", "file_rank", "key", "value"))
    spot = workspace.contexts(s.spark.createDataFrame([(path,)], "path string"), s.packages, s.root)
    return listed(workspace.values_by_context(rows, spot, rank, s.config["interpolation"]["enabled"]), s.root)


def listed(values_: DataFrame, root: str = "") -> DataFrame:
    name = F.when(F.col("source") == "File", workspace.relative(F.col("source_path"), root)).otherwise(text.source_name(F.col("source"), F.col("source_path"), F.lit("")))
    return values_.select(F.col("key").alias("name"), "value", name.alias("source"))


def env_example(s: Session) -> DataFrame:
    """Sorted NAME= lines of all variables that are defined or used."""
    index = s.index()
    return values.example(index.all_env_vars().union(index.values.select("key")))


def list_files(s: Session, path: str | None = None, all_files: bool = False) -> DataFrame:
    """(file) of env files: the active ones, or with `all_files` all, or those of the path's package and the workspace's root."""
    if "File" not in s.precedence:
        raise CommandError("File source is not enabled in configuration")
    env = workspace.env_files(s.files, s.config["workspace"]["env_files"])
    env = env if all_files else workspace.active(env, s.active)
    if path is not None and s.packages is not None:
        spot = workspace.contexts(s.spark.createDataFrame([(path,)], "path string"), s.packages, s.root).first()
        env = workspace.package_files(env, spot.package_root, spot.workspace_root)
    return env.select(workspace.relative(F.col("path"), s.root).alias("file")).orderBy("file")


def get_variable(s: Session, name: str | None = None) -> DataFrame:
    """(name, value, source) of one variable; no rows if there is none."""
    if not name:
        raise CommandError("Variable name required")
    return listed(s.index().values.where(F.col("key") == name), s.root)


def list_workspaces(s: Session) -> DataFrame:
    return s.said(name=os.path.basename(s.root.rstrip("/")) or "workspace", path=s.root, is_active=True)


def list_sources(s: Session) -> DataFrame:
    """(source, priority, n, enabled): how many variables come from each source; values in memory are not counted."""
    kinds = s.spark.createDataFrame([(k, p, k in s.precedence) for k, p in PRIORITIES], "source string, priority int, enabled boolean")
    return values.source_counts(s.index().values, kinds)


def set_precedence(s: Session, *names: str) -> DataFrame:
    s.config["resolution"]["precedence"] = config_.parsed_precedence(list(names))
    return s.said(success=True, precedence=s.precedence)


def set_root(s: Session, path: str | None = None) -> DataFrame:
    """Moves to another folder: files, config and index are read from there, all of them."""
    from envatlas.sources import files

    if not path:
        raise CommandError("Path argument required")
    if not os.path.exists(path):
        raise CommandError(f"Path does not exist: {path}")
    if not os.path.isdir(path):
        raise CommandError(f"Path is not a directory: {path}")
    s.root = os.path.realpath(path)
    s.config = config_.load(s.root, s.config)
    s.files = files.workspace(s.spark, s.root).withColumn("file_id", F.xxhash64("path"))
    return s.said(success=True, root=s.root)


def set_interpolation(s: Session, enabled: bool = True) -> DataFrame:
    s.config["interpolation"]["enabled"] = bool(enabled)
    return s.said(success=True, enabled=s.config["interpolation"]["enabled"])


def get_interpolation(s: Session) -> DataFrame:
    return s.said(enabled=s.config["interpolation"]["enabled"])


def authenticate(s: Session, provider: str | None = None, credentials: dict[str, str] | None = None) -> DataFrame:
    return s.said(success=s.providers.authenticate(provider, credentials))


def select_scope(s: Session, provider: str | None = None, scope: dict | None = None) -> DataFrame:
    s.providers.select(provider, scope or {})
    return s.said(success=True)


def refresh(s: Session, provider: str | None = None) -> DataFrame:
    """(provider, n): the secrets that the signed-in providers, or one of them, give now."""
    if provider:
        s.providers.get(provider)
    rows = s.providers.values(s.spark)
    return (rows.where(F.col("provider") == provider) if provider else rows).groupBy("provider").agg(F.count("*").alias("n"))


def spawn(s: Session, provider: str | None = None) -> DataFrame:
    s.providers.get(provider)
    return s.said(success=True)


def shutdown(s: Session, provider: str | None = None) -> DataFrame:
    s.providers.shutdown(provider)
    return s.said(success=True)


COMMANDS: dict[str, Callable[..., DataFrame]] = {
    "file.setActive": set_active, "listEnvVariables": list_variables, "generateEnvExample": env_example, "file.list": list_files, "variable.get": get_variable, "workspace.list": list_workspaces,
    "source.list": list_sources, "source.setPrecedence": set_precedence, "workspace.setRoot": set_root, "interpolation.set": set_interpolation, "interpolation.get": get_interpolation,
}
for _family in ("source.remote", "provider"):
    COMMANDS |= {
        f"{_family}.list": lambda s: s.providers.listed(s.spark),
        f"{_family}.authFields": lambda s, provider=None: s.providers.auth_fields(s.spark, provider),
        f"{_family}.authenticate": authenticate,
        f"{_family}.navigate": lambda s, provider=None, level="", parent=None: s.providers.navigate(s.spark, provider, level, parent),
        f"{_family}.select": select_scope,
        f"{_family}.refresh": refresh,
    }
COMMANDS |= {"provider.spawn": spawn, "provider.scopeLevels": lambda s, provider=None: s.providers.scope_levels(s.spark, provider), "provider.shutdown": shutdown}
