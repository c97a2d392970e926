"""Remote sources of values: providers that the user registers, what they ask for and offer, and a data source that reads them.

A provider lives in Python and is read by tasks, one partition a chosen scope; its metadata are small tables. FolderProvider, which serves JSON
files, is both an example and a way to bring in exported secrets.
"""

from __future__ import annotations

import base64
import json
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

VALUES = "source string, provider string, source_path string, file_rank int, key string, value string"


@dataclass(frozen=True)
class AuthField:
    name: str
    label: str
    description: str | None = None
    required: bool = True
    secret: bool = False
    env_var: str | None = None
    default: str | None = None


@dataclass(frozen=True)
class ScopeLevel:
    name: str
    display_name: str
    required: bool = True


class Provider(ABC):
    """A source of secrets: who asks for what, which scopes there are, and the secrets of a scope. Must be picklable."""

    id: str
    name: str
    short_name: str | None = None
    levels: tuple[ScopeLevel, ...] = ()

    def auth_fields(self) -> list[AuthField]:
        return []

    @abstractmethod
    def authenticate(self, credentials: dict[str, str]) -> bool: ...

    @abstractmethod
    def options(self, level: str, selected: dict[str, list[str]]) -> list[str]:
        """What may be chosen at a level, given the choices above."""

    @abstractmethod
    def secrets(self, scope: dict[str, str]) -> Iterator[tuple[str, str]]:
        """(key, value) of one choice at every level."""


class FolderProvider(Provider):
    """Secrets in files root/project/environment.json, each an object of strings."""

    id, name, short_name = "folder", "Folder of JSON files", "folder"
    levels = (ScopeLevel("project", "Project"), ScopeLevel("environment", "Environment"))

    def __init__(self, root: str, token: str | None = None):
        self.root, self._token = root, token

    def auth_fields(self) -> list[AuthField]:
        return [AuthField("token", "Token", "Any text where the folder needs none", required=self._token is not None, secret=True, env_var="FOLDER_TOKEN")]

    def authenticate(self, credentials: dict[str, str]) -> bool:
        return self._token is None or credentials.get("token") == self._token

    def options(self, level: str, selected: dict[str, list[str]]) -> list[str]:
        if level == "project":
            return sorted(p.name for p in Path(self.root).iterdir() if p.is_dir())
        return sorted({p.stem for project in selected.get("project", []) for p in (Path(self.root) / project).glob("*.json")})

    def secrets(self, scope: dict[str, str]) -> Iterator[tuple[str, str]]:
        path = Path(self.root) / scope["project"] / f"{scope['environment']}.json"
        if path.exists():
            yield from sorted((k, str(v)) for k, v in json.loads(path.read_text(encoding="utf-8")).items())


@dataclass
class Registry:
    """The session's providers, which of them are signed in, and the scopes chosen."""

    providers: dict[str, Provider] = field(default_factory=dict)
    signed_in: set[str] = field(default_factory=set)
    chosen: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    def register(self, provider: Provider) -> None:
        self.providers[provider.id] = provider

    def get(self, provider: str | None) -> Provider:
        if not provider:
            raise ValueError("Provider ID required")
        if provider not in self.providers:
            raise ValueError(f"Provider '{provider}' not found")
        return self.providers[provider]

    def authenticate(self, provider: str | None, credentials: dict[str, str] | None) -> bool:
        p = self.get(provider)
        if credentials is None:
            raise ValueError("Credentials required")
        missing = [f.name for f in p.auth_fields() if f.required and not credentials.get(f.name, f.default)]
        ok = not missing and p.authenticate(credentials)
        (self.signed_in.add if ok else self.signed_in.discard)(p.id)
        return ok

    def shutdown(self, provider: str | None) -> None:
        p = self.get(provider)
        self.signed_in.discard(p.id)
        self.chosen.pop(p.id, None)

    def select(self, provider: str | None, scope: dict[str, list[str]]) -> None:
        p = self.get(provider)
        unknown = set(scope) - {x.name for x in p.levels}
        if unknown:
            raise ValueError(f"Unknown scope level: {sorted(unknown)[0]}")
        self.chosen[p.id] = {k: [v] if isinstance(v, str) else list(v) for k, v in scope.items()}

    # Metadata tables
    def listed(self, spark: SparkSession) -> DataFrame:
        rows = [(p.id, p.name, p.short_name or p.id, p.id in self.signed_in, json.dumps(self.chosen.get(p.id, {}), sort_keys=True)) for p in self.providers.values()]
        return spark.createDataFrame(rows, "id string, display_name string, short_name string, is_authenticated boolean, scope string")

    def auth_fields(self, spark: SparkSession, provider: str | None) -> DataFrame:
        p = self.get(provider)
        return spark.createDataFrame([(p.id, f.name, f.label, f.description, f.required, f.secret, f.env_var, f.default) for f in p.auth_fields()], "provider string, name string, label string, description string, required boolean, secret boolean, env_var string, default string")

    def scope_levels(self, spark: SparkSession, provider: str | None) -> DataFrame:
        p = self.get(provider)
        return spark.createDataFrame([(p.id, i, x.name, x.display_name, x.required) for i, x in enumerate(p.levels)], "provider string, ord int, name string, display_name string, required boolean")

    def navigate(self, spark: SparkSession, provider: str | None, level: str, parent: dict[str, list[str]] | None = None) -> DataFrame:
        p = self.get(provider)
        return spark.createDataFrame([(p.id, level, o) for o in p.options(level, parent or self.chosen.get(p.id, {}))], "provider string, level string, option string")

    def values(self, spark: SparkSession) -> DataFrame:
        """Value rows of all providers that are signed in, read by tasks."""
        spark.dataSource.register(Remote)
        out = None
        for p in self.providers.values():
            if p.id in self.signed_in:
                # readers are planned in a process of their own, so that the provider travels with the options
                packed = base64.b64encode(cloudpickle.dumps((p, self.chosen.get(p.id, {})))).decode()
                part = spark.read.format("remote").option("provider", packed).load()
                out = part if out is None else out.unionByName(part)
        return out if out is not None else spark.createDataFrame([], VALUES)


class _Scope(InputPartition):
    def __init__(self, scope: dict[str, str], rank: int):
        self.scope, self.rank = scope, rank


class _Reader(DataSourceReader):
    def __init__(self, provider: Provider, chosen: dict[str, list[str]]):
        self.provider, self.chosen = provider, chosen

    def partitions(self) -> list[InputPartition]:
        scopes: list[dict[str, str]] = [{}]
        for level in self.provider.levels:
            scopes = [s | {level.name: o} for s in scopes for o in (self.chosen.get(level.name) or self.provider.options(level.name, {k: [v] for k, v in s.items()}))]
        return [_Scope(s, i) for i, s in enumerate(scopes)]

    def read(self, partition: _Scope) -> Iterator[tuple]:
        path = "/".join(partition.scope.values())
        for key, value in self.provider.secrets(partition.scope):
            yield "Remote", self.provider.id, path, partition.rank, key, value


class Remote(DataSource):
    """spark.read.format("remote"): value rows of a registered provider, a partition for each chosen scope."""

    @classmethod
    def name(cls) -> str:
        return "remote"

    def schema(self) -> str:
        return VALUES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*cloudpickle.loads(base64.b64decode(self.options["provider"])))
