"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_ERROR_CHARACTERS = 30


def line_at(content: Column, offset: Column) -> Column:
    """The zero-based line of a character offset."""
    before = F.substring(content, F.lit(1), offset.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def column_at(content: Column, offset: Column) -> Column:
    """The zero-based character in its line of a character offset."""
    return F.length(F.substring_index(F.substring(content, F.lit(1), offset.cast("int")), "\n", -1))


def is_variable_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), F.lit(False))


def truncated(text: Column, most: int = MOST_ERROR_CHARACTERS) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def without_quotes(text: Column, quotes: str = "\"'`") -> Column:
    return F.btrim(text, F.lit(quotes))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def is_relative(specifier: Column) -> Column:
    return specifier.startswith("./") | specifier.startswith("../")


def normalised(path: Column) -> Column:
    """The path without . and .. steps; one that climbs above its root becomes null."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        steps, empty,
        lambda done, s: F.when(done.isNull(), F.lit(None)).when(s != "..", F.concat(done, F.array(s))).when(F.size(done) == 0, F.lit(None)).otherwise(F.slice(done, F.lit(1), F.size(done) - 1)),
    )
    return F.array_join(folded, "/")


def matches_any(name: Column, globs: list[str]) -> Column:
    """Whether a file name matches one of the globs (* and ?)."""
    one = [re.escape(g).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") for g in globs]
    return name.rlike(rf"\A(?:{'|'.join(one)})\z") if one else F.lit(False)


def shown(value: Column) -> Column:
    """A value for display: empty values named, line ends visible."""
    return F.when(value == "", "*(empty)*").otherwise(F.replace(value, F.lit("\n"), F.lit("\\n")))


def source_name(kind: Column, path: Column, provider: Column) -> Column:
    """Where a value comes from, as a user reads it."""
    remote = F.concat(F.lit("Remote: "), provider, F.when(path.isNotNull(), F.concat(F.lit(" ("), path, F.lit(")"))).otherwise(F.lit("")))
    return F.when(kind == "File", base_name(path)).when(kind == "Shell", "Shell Environment").when(kind == "Memory", "Memory").otherwise(remote)
