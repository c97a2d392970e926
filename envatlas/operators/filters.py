"""Small tests and projections on resolved things, exports and imports, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envatlas.functions import text


def as_variable(kind: Column, name: Column) -> Column:
    """The name where something resolved to a variable."""
    return F.when(kind == "Variable", name)


def as_object(kind: Column, name: Column) -> Column:
    """The name where something resolved to the environment's object."""
    return F.when(kind == "Object", name)


def import_kind(original: Column, module: Column, alias: Column, statement: Column | None = None) -> Column:
    """What an import brings: a module's Default, its whole Namespace, one Named export, one under another name (NamedAliased), or only SideEffects."""
    whole = F.coalesce(statement.rlike(r"\*\s*as\s"), F.lit(False)) if statement is not None else F.lit(False)
    return F.when(alias.isNull(), "SideEffect").when(whole, "Namespace").when(original == module, "Default").when(original == alias, "Named").otherwise("NamedAliased")


def imported_name(kind: Column, original: Column) -> Column:
    """The export that an import asks for: `default` of a default import, none of a namespace."""
    return F.when(kind == "Default", "default").when(kind.isin("Named", "NamedAliased"), original)


def is_namespace(kind: Column) -> Column:
    return kind == "Namespace"


def is_default(kind: Column) -> Column:
    return kind == "Default"


def is_package(specifier: Column) -> Column:
    return ~text.is_relative(specifier) & ~specifier.startswith("/")


def shown(kind: Column, kinds: tuple[str, ...]) -> Column:
    """Whether hints are shown for locations of a kind."""
    return kind.isin(*kinds)


def is_exports_empty(files: DataFrame, exports: DataFrame, wildcards: DataFrame) -> DataFrame:
    """Files (file_id) that export nothing, not even others' names."""
    return files.join(exports.select("file_id").union(wildcards.select("file_id")).distinct(), "file_id", "left_anti")


def files_for(env_to_files: DataFrame, names: list[str]) -> DataFrame:
    """(name, file_id) of the given variables, from either inverted index."""
    return env_to_files.where(F.col("name").isin(*names))


def variables_in(env_to_files: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, name) of the variables in the given files (file_id)."""
    return env_to_files.join(files.select("file_id").distinct(), "file_id", "left_semi").select("file_id", "name")


def destructured_key(said: Column) -> Column:
    """The key in `KEY: local`, or the whole where no local name is given."""
    return F.trim(F.substring_index(said, ":", 1))


def extracted_name(said: Column, quotes: str = "\"'") -> Column:
    """The name in a token: blanks and the language's quotes go."""
    return F.btrim(F.trim(said), F.lit(quotes))
