"""What a user asks of the workspace: hover, completion, definition, references, symbols, rename, diagnostics and hints, as tables.

Every endpoint answers all probes at once. `values_` has key, value, source_path, source and optionally description; `definitions` one row a key:
the file and the range of its name in the first env file that has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envatlas.functions import ranges, text
from envatlas.functions.settled import with_all
from envatlas.operators import locations, positions, values
from envatlas.operators.graph import Graph, of_kind

SEVERITY = {"syntax-error": "ERROR", "undefined-env-var": "WARNING"}
RENAMED = ("DirectReference", "BindingDeclaration", "PropertyAccess")
CONTAINER = "Environment Variables"
_RANGE = ("sl", "sc", "el", "ec")


def definitions(entries: DataFrame, env: DataFrame) -> DataFrame:
    """(key, file_id, sl, sc, el, ec) of each key's first line in the first env file (file_id, file_rank) that defines it."""
    good = entries.where("not is_comment and error_code is null and key <> ''").join(env.select("file_id", "file_rank"), "file_id")
    best = good.groupBy("key").agg(F.min(F.struct("file_rank", "file_id", "ord", "sl", "sc", "ec")).alias("x"))
    return best.select("key", "x.file_id", "x.sl", "x.sc", F.col("x.sl").alias("el"), "x.ec")


def hover(hits: DataFrame, values_: DataFrame, enabled: bool = True) -> DataFrame:
    """Adds markdown to resolved positions: the value and its source of a variable, or what stands for the environment's object. Variables without a value have none."""
    if not enabled:
        return hits.limit(0).withColumn("markdown", F.lit(None).cast("string"))
    v = values_.select(F.col("key").alias("variable"), "value", "source", "source_path", *(["description"] if "description" in values_.columns else [F.lit(None).cast("string").alias("description")]))
    out = hits.join(v, "variable", "left")
    shown = hover_text(F.col("variable"), F.col("name"), F.col("value"), text.source_name(F.col("source"), F.col("source_path"), F.lit("")), F.col("description"))
    object_ = F.concat(F.lit("**`"), F.col("name"), F.lit("`** → **`"), F.col("variable"), F.lit("`**\n\n*Environment Object*"))
    return out.withColumn("markdown", F.when(F.col("resolved_kind") == "Object", object_).when(F.col("value").isNotNull(), shown)).drop("value", "source", "source_path", "description")


def hover_text(variable: Column, name: Column, value: Column, source: Column, description: Column) -> Column:
    """The text that describes a variable: its name, and the local one where that differs, value, source and description."""
    head = F.when(name.isNotNull() & (name != variable), F.concat(F.lit("**`"), name, F.lit("`** → **`"), variable, F.lit("`**"))).otherwise(F.concat(F.lit("**`"), variable, F.lit("`**")))
    said = F.when(value == "", "*(empty)*").otherwise(F.concat(F.lit("`"), F.replace(value, F.lit("\n"), F.lit("`\n`")), F.lit("`")))
    more = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("\n\n*"), description, F.lit("*"))).otherwise(F.lit(""))
    return F.concat(head, F.lit("\n\n**Value**: "), said, F.lit("\n\n**Source**: `"), source, F.lit("`"), more)


def completion(probes: DataFrame, graph: Graph, values_: DataFrame, objects: dict[str, tuple[str, ...]], imported: DataFrame | None = None, strict: bool = True, enabled: bool = True) -> DataFrame:
    """(file_id, probe_id, label, detail, documentation) for probes with `context` and `lang` (see extract.by_cursor): all variables, where names complete.

    In strict mode the context must be one of its language's objects or a valid symbol or an import that stands for the object.
    """
    if not enabled:
        probes = probes.limit(0)
    asked = probes.where("context is not null") if strict else probes
    if strict:
        standard = F.lit(False)
        for lang, of in objects.items():
            standard = standard | ((F.col("lang") == lang) & (F.col("context").isin(*of) if of else F.lit(True)))
        held = graph.symbols.where("is_valid and resolved_kind = 'Object'").select("file_id", F.col("name").alias("context"))
        if imported is not None:
            held = held.union(imported.where("res_kind = 'EnvObject'").select("file_id", "alias"))
        asked = asked.join(held.distinct().withColumn("held", F.lit(True)), ["file_id", "context"], "left").where(standard | F.col("held").isNotNull())
    asked = asked.select("file_id", "probe_id").distinct()
    labels = values_.select(F.col("key").alias("label"), text.source_name(F.col("source"), F.col("source_path"), F.lit("")).alias("detail"), F.concat(F.lit("**Value**: "), F.when(F.col("value") == "", "*(empty)*").otherwise(F.concat(F.lit("`"), F.col("value"), F.lit("`")))).alias("documentation"))
    return with_all(asked, labels, "probe_id")  # every asker gets every variable


def definition(hits: DataFrame, definitions_: DataFrame, values_: DataFrame | None = None) -> DataFrame:
    """Adds where each resolved variable is defined: def_file, def_sl, def_sc, def_el, def_ec. With `values_`, only variables whose value comes from a file have one."""
    d = definitions_.select(F.col("key").alias("variable"), F.col("file_id").alias("def_file"), *[F.col(c).alias(f"def_{c}") for c in _RANGE])
    if values_ is not None:
        d = d.join(values_.where("source = 'File'").select(F.col("key").alias("variable")).distinct(), "variable", "left_semi")
    return hits.join(d, "variable", "left")


def references(names: DataFrame, locations_: DataFrame, definitions_: DataFrame | None = None) -> DataFrame:
    """(name, file_id, kind, range) of all places of the variables `names` has, but uses of local names; with their definitions if given, none twice."""
    asked = names.select("name").distinct()
    found = locations_.where("kind <> 'BindingUsage'").join(asked, "name").select("name", "file_id", "kind", *_RANGE)
    if definitions_ is None:
        return found
    d = definitions_.select(F.col("key").alias("name"), "file_id", F.lit("Definition").alias("kind"), *_RANGE).join(asked, "name", "left_semi")
    return found.unionByName(d.join(found.select("name", "file_id", *_RANGE), ["name", "file_id", *_RANGE], "left_anti"))


def workspace_symbols(query: str, locations_: DataFrame, definitions_: DataFrame, exported: DataFrame | None = None) -> DataFrame:
    """(name, file_id, range, container) of variables whose name holds the query, case aside, by name: where they are defined, else their first place.

    The first place is that of least file and range. `exported` (file_id, name) adds variables that files only export, at the file's start.
    """
    hit = F.contains(F.lower("name"), F.lower(F.lit(query)))
    used = locations_.where(hit).groupBy("name").agg(F.min(F.struct("file_id", *_RANGE)).alias("u"))
    if exported is not None:
        more = exported.where(hit).groupBy("name").agg(F.min(F.struct("file_id", *[F.lit(0).alias(c) for c in _RANGE])).alias("u"))
        used = used.unionByName(more.join(used, "name", "left_anti"))
    d = definitions_.select(F.col("key").alias("name"), F.struct("file_id", *_RANGE).alias("d"))
    at = F.coalesce("d", "u")
    return used.join(d, "name", "left").select("name", *[at[c].alias(c) for c in ("file_id", *_RANGE)], F.lit(CONTAINER).alias("container")).orderBy("name")


def env_key_at(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """The key at each position of an env file, its end included: variable and range."""
    near = probes.join(entries.where("not is_comment and error_code is null").select("file_id", F.col("sl").alias("line"), "key", "sc", "ec"), ["file_id", "line"]).where("character >= sc and character <= ec")
    return near.select("file_id", "probe_id", F.col("key").alias("variable"), F.col("line").alias("sl"), "sc", F.col("line").alias("el"), "ec")


def prepare_rename(probes: DataFrame, targets: DataFrame, entries: DataFrame) -> DataFrame:
    """(file_id, probe_id, variable, range) of positions that a rename may start from, in code and in env files: their variable's name must be valid."""
    code = positions.at(probes, targets, variables_only=True).where("variable is not null").select("file_id", "probe_id", "variable", *_RANGE)
    return code.unionByName(env_key_at(probes, entries)).where(text.is_variable_name(F.col("variable")))


def rename(names: DataFrame, locations_: DataFrame, definitions_: DataFrame) -> DataFrame:
    """(old, file_id, range, new_text): the edits that rename each variable (old, new_text).

    References, declarations by the variable's own name and property accesses are edited in every file; the definition where its file has no
    edits. New names that are no valid names give none, and other names that only begin alike are left alone.
    """
    asked = names.where(text.is_variable_name(F.col("new_text")))
    edits = locations_.where(F.col("kind").isin(*RENAMED)).withColumnRenamed("name", "old").join(asked, "old").select("old", "file_id", *_RANGE, "new_text")
    d = definitions_.withColumnRenamed("key", "old").join(asked, "old").select("old", "file_id", *_RANGE, "new_text")
    return edits.unionByName(d.join(edits.select("old", "file_id").distinct(), ["old", "file_id"], "left_anti"))


def workspace_edit(edits: DataFrame) -> DataFrame:
    """(old, file_id, edits): one row a file, its edits in order of their places."""
    return edits.groupBy("old", "file_id").agg(F.array_sort(F.collect_list(F.struct(*_RANGE, "new_text"))).alias("edits"))


def diagnostics(graph: Graph, defined: DataFrame, enabled: bool = True) -> DataFrame:
    """(file_id, code, severity, message, range): syntax errors, and variables that no source defines.

    Direct references, symbols that a variable is bound to at once and property accesses are judged; symbols further down a chain are not.
    """
    at_name = [F.col(f"n{c}").alias(c) for c in _RANGE]
    errors = of_kind(graph.facts, "error").select("file_id", F.lit("syntax-error").alias("code"), F.col("name").alias("message"), *at_name)
    names = graph.references.select("file_id", "name", *at_name)
    names = names.unionByName(graph.symbols.where("origin_kind = 'EnvVar'").select("file_id", F.col("origin_name").alias("name"), *at_name))
    names = names.unionByName(graph.usages.where("property is not null").select("file_id", F.col("property").alias("name"), *at_name))
    missing = values.undefined(names, defined).select("file_id", F.lit("undefined-env-var").alias("code"), undefined_message(F.col("name")).alias("message"), *_RANGE)
    out = errors.unionByName(missing)
    out = out if enabled else out.limit(0)
    return out.withColumn("severity", F.when(F.col("code") == "syntax-error", SEVERITY["syntax-error"]).otherwise(SEVERITY["undefined-env-var"]))


def undefined_message(name: Column) -> Column:
    return F.concat(F.lit("Environment variable '"), name, F.lit("' is not defined."))


def env_diagnostics(entries: DataFrame) -> DataFrame:
    """(file_id, code, severity, range) of env files' errors, each one character wide; invalid UTF-8 is a warning, the others errors."""
    at = F.coalesce("error_at", "sc") if "error_at" in entries.columns else F.col("sc")
    return entries.where("error_code is not null").select("file_id", F.col("error_code").alias("code"), F.when(F.col("error_code") == "EDF006", "WARNING").otherwise("ERROR").alias("severity"), "sl", at.alias("sc"), F.col("sl").alias("el"), (at + 1).alias("ec"))


def inlay_hints(locations_: DataFrame, values_: DataFrame, shown: tuple[str, ...] = RENAMED, window: tuple[int, int, int, int] | None = None, most_length: int = 30, most_a_line: int = 0, enabled: bool = True, known: DataFrame | None = None) -> DataFrame:
    """(file_id, name, line, character, label, source): values after the places of variables, of the kinds in `shown`, inside a window of the text.

    Values are cut at `most_length` characters (0: not). With `most_a_line`, only the first ones of a line are shown. `known` (file_id, name) restricts a file's variables.
    """
    loc = locations_.where(F.col("kind").isin(*shown))
    if known is not None:
        loc = loc.join(known.select("file_id", "name").distinct(), ["file_id", "name"], "left_semi")
    if window:
        a, b = (ranges.point(F.lit(window[i]), F.lit(window[i + 1])) for i in (0, 2))
        loc = loc.where(ranges.overlap(ranges.point(F.col("sl"), F.col("sc")), ranges.point(F.col("el"), F.col("ec")), a, b))
    value = text.shown(F.col("value"))
    value = text.truncated(value, most_length) if most_length else value
    out = loc.join(values_.select(F.col("key").alias("name"), "value", "source", "source_path"), "name").select("file_id", "name", F.col("el").alias("line"), F.col("ec").alias("character"), value.alias("label"), text.source_name(F.col("source"), F.col("source_path"), F.lit("")).alias("source"))
    out = out if enabled else out.limit(0)
    return locations.capped(out, ["file_id", "line"], ["character", "name"], most_a_line) if most_a_line else out
