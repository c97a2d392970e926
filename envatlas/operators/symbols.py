"""Symbols: name lookup through nested scopes, usages, invalidation, and what a chain of origins resolves to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envatlas.functions.settled import settled

#: Nodes of an origin chain that are followed; exports follow more.
MOST_HOPS = 10
MOST_EXPORT_HOPS = 20
TERMINAL = ("EnvVar", "EnvObject", "Unknown", "Unresolvable")
ENV_RELATED = ("EnvVar", "EnvObject", "Symbol", "Destructured")


def is_terminal(origin):
    return origin.isin(*TERMINAL)


def is_env_related(origin):
    return origin.isin(*ENV_RELATED)


def lookup(probes: DataFrame, closure: DataFrame, symbols: DataFrame, valid_only: bool = True) -> DataFrame:
    """Adds symbol_id to the probes (file_id, probe_id, name, scope_id): the latest (valid) symbol of that name in the nearest scope, or null."""
    found = symbols.where("is_valid") if valid_only else symbols
    found = found.select("file_id", "name", F.col("scope_id").alias("ancestor_id"), "symbol_id")
    near = probes.join(closure, ["file_id", "scope_id"]).join(found, ["file_id", "name", "ancestor_id"])
    best = near.groupBy("file_id", "probe_id").agg(F.min(F.struct("depth", (-F.col("symbol_id")).alias("later"))).alias("best"))
    return probes.join(best, ["file_id", "probe_id"], "left").select(*probes.columns, (-F.col("best.later")).alias("symbol_id"))


def usages(identifiers: DataFrame, closure: DataFrame, symbols: DataFrame) -> DataFrame:
    """Identifiers (with `at`) that name a symbol whose declaration ended before them."""
    end = symbols.select("file_id", "symbol_id", "decl_end")
    return lookup(identifiers, closure, symbols).where("symbol_id is not null").join(end, ["file_id", "symbol_id"]).where("at > decl_end").drop("decl_end")


def invalidated(symbols: DataFrame, reassignments: DataFrame, closure: DataFrame) -> DataFrame:
    """Symbols with is_valid false where the name is reassigned in their scope or one around it."""
    hit = symbols.select("file_id", "symbol_id", "name", "scope_id").join(closure, ["file_id", "scope_id"]).join(reassignments.select("file_id", "name", F.col("scope_id").alias("ancestor_id")).distinct(), ["file_id", "name", "ancestor_id"], "left_semi")
    hit = hit.select("file_id", "symbol_id").distinct().withColumn("hit", F.lit(True))
    return symbols.join(hit, ["file_id", "symbol_id"], "left").withColumn("is_valid", F.col("is_valid") & F.col("hit").isNull()).drop("hit")


def resolve(symbols: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """(file_id, symbol_id, resolved_kind, resolved_name): what each symbol's origins lead to within `most` nodes, or null.

    symbols: file_id, symbol_id, origin_kind, origin_name, origin_target, origin_key. A destructured key of an object is a
    variable; of a variable it is nothing. Chains double their reach each round, so that `most` nodes take a logarithmic number of joins.
    """
    # each row: after `hops` edges from the symbol, the node it stands on, and the first key taken on the way (a second one ends it)
    key = F.when(F.col("origin_kind") == "Destructured", F.col("origin_key"))
    step = symbols.select("file_id", "symbol_id", F.when(F.col("origin_kind").isin("Symbol", "Destructured"), F.col("origin_target")).alias("next"), key.alias("key"), F.lit(1).alias("hops"))
    ends = symbols.select("file_id", F.col("symbol_id").alias("end"), F.col("origin_kind").alias("kind"), F.col("origin_name").alias("name"))
    at = settled(step)
    reach = 1
    while reach < most:
        ahead = at.select("file_id", F.col("symbol_id").alias("next"), F.col("next").alias("next2"), F.col("key").alias("key2"), F.col("hops").alias("hops2"))
        at = at.join(ahead, ["file_id", "next"], "left").select(
            "file_id", "symbol_id",
            F.coalesce("next2", "next").alias("next"),
            F.when(F.col("next2").isNull(), F.col("key")).when(F.col("key").isNotNull() & F.col("key2").isNotNull(), F.lit("\x00")).otherwise(F.coalesce("key", "key2")).alias("key"),
            F.when(F.col("next2").isNull(), F.col("hops")).otherwise(F.col("hops") + F.col("hops2")).alias("hops"),
        )
        at = settled(at)
        reach *= 2
    node = F.coalesce("next", "symbol_id")
    nodes = F.when(F.col("next").isNull(), 1).otherwise(F.col("hops") + 1)
    done = at.select("file_id", "symbol_id", node.alias("end"), nodes.alias("nodes"), "key").join(ends, ["file_id", "end"], "left")
    ok = F.col("nodes") <= most
    kind = F.when(~ok, None).when(F.col("key").isNull() & (F.col("kind") == "EnvVar"), "Variable").when(F.col("key").isNull() & (F.col("kind") == "EnvObject"), "Object").when((F.col("kind") == "EnvObject") & (F.col("key") != "\x00"), "Variable")
    name = F.when(kind == "Object", F.col("name")).when(F.col("key").isNotNull(), F.col("key")).otherwise(F.col("name"))
    return done.select("file_id", "symbol_id", kind.alias("resolved_kind"), F.when(kind.isNotNull(), name).alias("resolved_name"))
