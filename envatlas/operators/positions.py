"""What stands at a position: lookups by cursor over the symbol graphs of all files at once.

Names do not span lines, so every lookup is an equi-join on file and line with a comparison of characters on what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envatlas.operators.graph import Graph

#: What a cursor may hit, the preferred first.
PRIORITY = ("DirectReference", "LocalBinding", "DestructureKey", "LocalUsage", "CrossModule", "ImportedEnvObjectProperty")
_RANGE = ("sl", "sc", "el", "ec")


def targets(graph: Graph, imported: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """(file_id, prio, hit, seq, name, resolved_kind, variable, symbol_id, module, range): all that a cursor may hit.

    imported: what graph.imported() gives; then names of other files' exports are hit too, and properties of objects they export.
    """
    facts = graph.facts if facts is None else facts
    none = F.lit(None).cast("string")
    name_range = [F.col(f"n{c}").alias(c) for c in _RANGE]

    def row(df: DataFrame, hit: str, seq, name, kind, variable, symbol, module, span) -> DataFrame:
        return df.select("file_id", F.lit(PRIORITY.index(hit)).alias("prio"), F.lit(hit).alias("hit"), seq.cast("long").alias("seq"), name.alias("name"), kind.alias("resolved_kind"), variable.alias("variable"), symbol.cast("int").alias("symbol_id"), module.alias("module"), *span)

    held = graph.symbols.where("resolved_kind is not null")
    no_id = F.lit(None)
    parts = [
        row(graph.references, "DirectReference", F.col("ord"), F.col("name"), F.lit("Variable"), F.col("name"), no_id, none, name_range),
        row(held, "LocalBinding", F.col("symbol_id"), F.col("name"), F.col("resolved_kind"), F.col("resolved_name"), F.col("symbol_id"), none, name_range),
        row(held.where("ksl is not null"), "DestructureKey", F.col("symbol_id"), F.col("name"), F.col("resolved_kind"), F.col("resolved_name"), F.col("symbol_id"), none, [F.col(f"k{c}").alias(c) for c in _RANGE]),
        row(graph.usages, "LocalUsage", F.col("ord"), F.coalesce("property", "identifier"), F.when(F.col("property").isNotNull(), "Variable").otherwise(F.col("resolved_kind")), F.coalesce("variable", "identifier"), F.col("symbol_id"), none, name_range),
    ]
    if imported is not None:
        words = facts.where("kind = 'identifier'").select("file_id", F.col("name").alias("alias"), "ord", *[f"n{c}" for c in _RANGE])
        kind = F.when(F.col("res_kind") == "EnvVar", "Variable").otherwise("Object")
        parts.append(row(words.join(imported, ["file_id", "alias"]), "CrossModule", F.col("ord"), F.col("alias"), kind, F.col("res_name"), no_id, F.col("module"), name_range))
        members = facts.where("kind = 'property'").select("file_id", F.col("source").alias("alias"), "name", "ord", *[f"n{c}" for c in _RANGE])
        objects = imported.where("res_kind = 'EnvObject'")
        parts.append(row(members.join(objects, ["file_id", "alias"]), "ImportedEnvObjectProperty", F.col("ord"), F.col("name"), F.lit("Variable"), F.col("name"), no_id, F.col("module"), name_range))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def at(probes: DataFrame, targets_: DataFrame, variables_only: bool = False, hits: list[str] | None = None) -> DataFrame:
    """Adds to probes (file_id, probe_id, line, character) the first thing each one hits, in order of PRIORITY; nulls where nothing is hit.

    Positions are distinct before they are joined, however many probes share one.
    """
    t = targets_.where("resolved_kind = 'Variable'") if variables_only else targets_
    t = t.where(F.col("hit").isin(*hits)) if hits else t
    spots = probes.select("file_id", "line", "character").distinct()
    near = spots.join(t.withColumnRenamed("sl", "line"), ["file_id", "line"]).where("character >= sc and character < ec")
    best = near.groupBy("file_id", "line", "character").agg(F.min(F.struct("prio", "seq", "hit", "name", "resolved_kind", "variable", "symbol_id", "module", F.struct(F.col("line").alias("sl"), "sc", "el", "ec").alias("span"))).alias("x"))
    best = best.select("file_id", "line", "character", "x.hit", "x.name", "x.resolved_kind", "x.variable", "x.symbol_id", "x.module", "x.span.*")
    return probes.join(best, ["file_id", "line", "character"], "left")


def env_at(probes: DataFrame, graph: Graph) -> DataFrame:
    """The variable or object at each position, through local names only."""
    return at(probes, targets(graph))


def resolved_at(probes: DataFrame, graph: Graph, imported: DataFrame | None = None) -> DataFrame:
    """The variable at each position, through local names first and then through other files' exports."""
    return at(probes, targets(graph, imported), variables_only=True)


def reference_at(probes: DataFrame, graph: Graph) -> DataFrame:
    return at(probes, targets(graph), hits=["DirectReference"])


def binding_at(probes: DataFrame, graph: Graph) -> DataFrame:
    """The symbol whose name or destructured key stands at each position; `binding_kind` is Object or Value, for valid symbols alone."""
    hit = at(probes, targets(graph), hits=["LocalBinding", "DestructureKey"])
    valid = graph.symbols.where("is_valid").select("file_id", "symbol_id", F.lit(True).alias("valid"))
    return hit.join(valid, ["file_id", "symbol_id"], "left").withColumn("binding_kind", F.when(F.col("valid"), F.when(F.col("resolved_kind") == "Object", "Object").otherwise("Value"))).drop("valid")


def usage_at(probes: DataFrame, graph: Graph) -> DataFrame:
    return at(probes, targets(graph), hits=["LocalUsage"])
