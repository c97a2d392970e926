"""The symbol graph of every file, from the extractor's facts: symbols with origins, usages, property accesses, locations and exports.

Each step is one join or aggregation over all files; files only meet where modules do. The order of the steps matters: usages are found
before reassignments make symbols invalid, and an assignment sees earlier symbols before it sees later ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envatlas.functions import ranges
from envatlas.functions.settled import settled
from envatlas.operators import locations as locations_
from envatlas.operators import modules, symbols
from envatlas.sources import extract

SPAN, NAME = ("sl", "sc", "el", "ec"), ("nsl", "nsc", "nel", "nec")
#: Order in which symbols come to be.
PHASES = {"binding": 0, "object": 0, "assignment": 1, "destructure": 2}


def of_kind(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.where(F.col("kind").isin(*kinds))


def closure(facts: DataFrame) -> DataFrame:
    """(file_id, scope_id, ancestor_id, depth) from the paths that scope rows carry: no iteration, at any depth."""
    paths = of_kind(facts, "scope").select("file_id", F.col("own").alias("scope_id"), F.posexplode("path").alias("depth", "ancestor_id"))
    roots = facts.select("file_id").distinct().select("file_id", F.lit(1).alias("scope_id"), F.lit(0).alias("depth"), F.lit(1).alias("ancestor_id"))
    return paths.unionByName(roots).select("file_id", "scope_id", "ancestor_id", "depth")


def scopes(facts: DataFrame) -> DataFrame:
    """(file_id, scope_id, parent_id, kind, start, end, size) of all scopes but the file's own."""
    at = {"start": ranges.point(F.col("sl"), F.col("sc")), "end": ranges.point(F.col("el"), F.col("ec")), "size": ranges.size(*map(F.col, SPAN))}
    return of_kind(facts, "scope").select("file_id", F.col("own").alias("scope_id"), F.col("scope").alias("parent_id"), F.col("name").alias("kind"), *[c.alias(k) for k, c in at.items()])


def declared(facts: DataFrame) -> DataFrame:
    """Symbols without resolved origins: numbered by file in the order of their making."""
    phase = F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv])[F.col("kind")]
    rows = of_kind(facts, *PHASES).withColumn("phase", phase)
    at = Window.partitionBy("file_id").orderBy("phase", "nsl", "nsc", "ord")
    origin = F.when(F.col("kind") == "binding", "EnvVar").when(F.col("kind") == "object", "EnvObject").when(F.col("kind") == "assignment", "Symbol").otherwise("Destructured")
    kind = F.when(F.col("kind") == "binding", "Value").when(F.col("kind") == "object", "EnvObject").when(F.col("kind") == "assignment", "Variable").otherwise("DestructuredProperty")
    return rows.select(
        "file_id", F.row_number().over(at).alias("symbol_id"), "name", F.col("scope").alias("scope_id"), origin.alias("origin_kind"),
        F.when(F.col("kind") == "binding", F.col("key")).when(F.col("kind") == "object", F.col("source")).alias("origin_name"), F.col("source").alias("origin_source"), F.when(F.col("kind") == "destructure", F.col("key")).alias("origin_key"),
        kind.alias("symbol_kind"), F.lit(True).alias("is_valid"), *NAME, "ksl", "ksc", "kel", "kec",
        # a binding or an alias is declared by its whole statement, the others by their names
        F.when(F.col("phase") == 0, ranges.point(F.col("el"), F.col("ec"))).otherwise(ranges.point(F.col("nel"), F.col("nec"))).alias("decl_end"),
    )


def with_origins(symbols_: DataFrame, closure_: DataFrame) -> DataFrame:
    """Adds origin_target: the symbol that an assigned or destructured source names.

    Of the symbols in the nearest scope the latest one before the new symbol counts; if no scope has an earlier one, a later one does. A
    source without a symbol makes the origin Unresolvable.
    """
    asked = symbols_.where(F.col("origin_kind").isin("Symbol", "Destructured")).select("file_id", "symbol_id", F.col("origin_source").alias("name"), "scope_id")
    named = symbols_.select("file_id", "name", F.col("scope_id").alias("ancestor_id"), F.col("symbol_id").alias("target"))
    near = asked.join(closure_, ["file_id", "scope_id"]).join(named, ["file_id", "name", "ancestor_id"])
    best = near.groupBy("file_id", "symbol_id").agg(F.min(F.struct((F.col("target") >= F.col("symbol_id")).alias("late"), "depth", (-F.col("target")).alias("t"))).alias("x"))
    out = symbols_.join(best.select("file_id", "symbol_id", (-F.col("x.t")).alias("origin_target")), ["file_id", "symbol_id"], "left")
    missing = F.col("origin_kind").isin("Symbol", "Destructured") & F.col("origin_target").isNull()
    return out.withColumn("origin_kind", F.when(missing, "Unresolvable").otherwise(F.col("origin_kind")))


def symbols_by_name(symbols_: DataFrame, names: DataFrame) -> DataFrame:
    """All symbols of a name in a file, whatever their scope: names has file_id and name."""
    return symbols_.join(names.select("file_id", "name").distinct(), ["file_id", "name"])


def import_context(facts: DataFrame) -> DataFrame:
    """(file_id, alias, module, original): what each imported name stands for; of several imports of one name the last one counts."""
    rows = of_kind(facts, "import").where("alias is not null")
    return rows.groupBy("file_id", "alias").agg(F.max_by(F.struct("module", F.col("name").alias("original")), F.struct("nsl", "nsc", "ord")).alias("x")).select("file_id", "alias", "x.module", "x.original")


def is_env_related(module: Column, known_modules: list[str]) -> Column:
    """Whether an imported name comes from a module that holds the environment."""
    return F.coalesce(module.isin(*known_modules), F.lit(False)) if known_modules else F.lit(False)


@dataclass
class Graph:
    """The tables of the analysed files; each is written once and read by the others."""

    facts: DataFrame
    closure: DataFrame
    symbols: DataFrame  # with resolved_kind, resolved_name, is_valid
    usages: DataFrame  # identifiers and property accesses that stand for a variable or the object

    @property
    def references(self) -> DataFrame:
        return of_kind(self.facts, "reference").select("file_id", "name", F.lit("Property").alias("access_type"), F.lit(False).alias("has_default"), F.lit(None).cast("string").alias("default_value"), *SPAN, *NAME, "ord")

    def locations(self, property_accesses: bool = True) -> DataFrame:
        """Where variables stand (see operators.locations)."""
        refs = self.references.select("file_id", "name", F.lit("DirectReference").alias("kind"), F.col("ord").alias("seq"), *[F.col(n).alias(s) for s, n in zip(SPAN, NAME, strict=True)])
        held = self.symbols.where("resolved_kind = 'Variable'")
        at_key = F.col("ksl").isNotNull()
        decl = held.where(at_key | (F.col("name") == F.col("resolved_name"))).select("file_id", F.col("resolved_name").alias("name"), F.lit("BindingDeclaration").alias("kind"), F.col("symbol_id").alias("seq"), *[F.coalesce(f"k{s}", f"n{s}").alias(s) for s in SPAN])
        uses = self.usages.where("variable is not null").select("file_id", F.col("variable").alias("name"), F.when(F.col("property").isNull(), "BindingUsage").otherwise("PropertyAccess").alias("kind"), F.col("ord").alias("seq"), *[F.col(n).alias(s) for s, n in zip(SPAN, NAME, strict=True)])
        return locations_.locations(refs, decl, uses if property_accesses else uses.where("kind <> 'PropertyAccess'"))

    def all_env_vars(self, include_property: bool = False) -> DataFrame:
        """(file_id, name): names read directly or held by a symbol; property accesses only if so told."""
        names = self.references.select("file_id", "name").union(self.symbols.where("resolved_kind = 'Variable'").select("file_id", "resolved_name"))
        if include_property:
            names = names.union(self.usages.where("property is not null and variable is not null").select("file_id", "variable"))
        return names.distinct()

    def stats(self) -> DataFrame:
        """(file_id, symbols, scopes, usages, refs), the file's own scope counted."""
        kinds = {"refs": self.references.select("file_id"), "symbols": self.symbols.select("file_id"), "usages": self.usages.select("file_id"), "scopes": of_kind(self.facts, "scope").select("file_id").union(self.facts.select("file_id").distinct())}
        rows = None
        for kind, ids in kinds.items():
            one = ids.select("file_id", F.lit(kind).alias("kind"))
            rows = one if rows is None else rows.union(one)
        return rows.groupBy("file_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("symbols", "scopes", "usages", "refs")])

    def document_size(self) -> DataFrame:
        """(file_id, lines): one more than the last line that a fact stands on."""
        return self.facts.groupBy("file_id").agg((F.max("el") + 1).alias("lines"))


def analysed(files: DataFrame, use_imports: bool = False) -> Graph:
    """The graph of code files (file_id, lang, content)."""
    return built(settled(extract.extract(files, use_imports)))


def built(facts: DataFrame) -> Graph:
    closure_ = settled(closure(facts))
    made = settled(with_origins(settled(declared(facts)), closure_))
    resolved = symbols.resolve(made.select("file_id", "symbol_id", "origin_kind", "origin_name", "origin_target", "origin_key"))
    made = settled(made.join(resolved, ["file_id", "symbol_id"], "left"))
    uses = usages(facts, closure_, made)
    again = of_kind(facts, "reassignment").select("file_id", "name", F.col("scope").alias("scope_id")).distinct()
    made = settled(symbols.invalidated(made, again, closure_))
    return Graph(facts, closure_, made, settled(uses))


def usages(facts: DataFrame, closure_: DataFrame, symbols_: DataFrame) -> DataFrame:
    """(file_id, ord, symbol_id, identifier, property, variable, resolved_kind, name range).

    An identifier after a symbol's declaration uses that symbol; a property of a symbol that stands for the object is its variable.
    """
    at = ranges.point(F.col("nsl"), F.col("nsc"))
    words = of_kind(facts, "identifier").select("file_id", F.col("ord").alias("probe_id"), "name", F.col("scope").alias("scope_id"), at.alias("at"), *NAME)
    found = symbols.usages(words, closure_, symbols_.select("file_id", "symbol_id", "name", "scope_id", "is_valid", "decl_end"))
    kinds = symbols_.where("resolved_kind is not null").select("file_id", "symbol_id", "resolved_kind", "resolved_name")
    plain = found.join(kinds, ["file_id", "symbol_id"]).select("file_id", F.col("probe_id").alias("ord"), "symbol_id", F.col("name").alias("identifier"), F.lit(None).cast("string").alias("property"), F.when(F.col("resolved_kind") == "Variable", F.col("resolved_name")).alias("variable"), "resolved_kind", *NAME)
    members = of_kind(facts, "property").select("file_id", F.col("ord").alias("probe_id"), F.col("source").alias("name"), F.col("scope").alias("scope_id"), F.col("name").alias("property"), *NAME)
    objects = kinds.where("resolved_kind = 'Object'")
    held = symbols.lookup(members, closure_, symbols_.select("file_id", "symbol_id", "name", "scope_id", "is_valid")).where("symbol_id is not null").join(objects, ["file_id", "symbol_id"])
    keyed = held.select("file_id", F.col("probe_id").alias("ord"), "symbol_id", F.col("name").alias("identifier"), "property", F.col("property").alias("variable"), "resolved_kind", *NAME)
    return plain.unionByName(keyed)


# Exports
def exports(graph: Graph) -> DataFrame:
    """(file_id, exported_name, local_name, res_kind, res_name, src_module, orig_name, is_default, ord, range): of each name a file's last export.

    What an export of its own stands for is looked up among the file's valid symbols, by the exported name first, then by the local
    one; a default export by its local name only. Chains are followed up to 20 nodes.
    """
    rows = of_kind(graph.facts, "export").select("file_id", F.col("name").alias("exported_name"), F.col("source").alias("local_name"), F.col("module").alias("src_module"), "ord", *NAME)
    rows = modules.last_exports(rows).withColumn("is_default", F.col("exported_name") == "default")
    far = symbols.resolve(graph.symbols.select("file_id", "symbol_id", "origin_kind", "origin_name", "origin_target", "origin_key"), symbols.MOST_EXPORT_HOPS + 1)
    valid = graph.symbols.where("is_valid").select("file_id", "symbol_id", "name").join(far.where("resolved_kind is not null"), ["file_id", "symbol_id"])
    # an object is preferred to a variable, then the first symbol
    held = valid.groupBy("file_id", "name").agg(F.min(F.struct((F.col("resolved_kind") != "Object").alias("late"), "symbol_id", "resolved_kind", "resolved_name")).alias("x")).select("file_id", "name", "x.resolved_kind", "x.resolved_name")
    by_name = held.select("file_id", F.col("name").alias("exported_name"), F.col("resolved_kind").alias("kind1"), F.col("resolved_name").alias("name1"))
    by_local = held.select("file_id", F.col("name").alias("local_name"), F.col("resolved_kind").alias("kind2"), F.col("resolved_name").alias("name2"))
    rows = rows.join(by_name, ["file_id", "exported_name"], "left").join(by_local, ["file_id", "local_name"], "left")
    first = F.col("kind1").isNotNull() & ~F.col("is_default")
    kind, name = F.when(first, F.col("kind1")).otherwise(F.col("kind2")), F.when(first, F.col("name1")).otherwise(F.col("name2"))
    again = F.col("src_module").isNotNull()
    return rows.select(
        "file_id", "exported_name", "local_name",
        F.when(again, "ReExport").when(kind == "Variable", "EnvVar").when(kind == "Object", "EnvObject").otherwise("Unknown").alias("res_kind"), F.when(~again, name).alias("res_name"),
        "src_module", F.when(again, F.coalesce("local_name", "exported_name")).alias("orig_name"), "is_default", "ord", *NAME,
    )


def wildcards(graph: Graph) -> DataFrame:
    """(file_id, ord, src_module) of re-exports of everything, in their order."""
    return of_kind(graph.facts, "wildcard").select("file_id", "ord", F.col("module").alias("src_module"))


def is_env_export(kind: Column) -> Column:
    return kind.isin("EnvVar", "EnvObject")


def exported_env_vars(exports_: DataFrame) -> DataFrame:
    """(file_id, name): the variables that files export under any name."""
    return exports_.where("res_kind = 'EnvVar'").select("file_id", F.col("res_name").alias("name")).distinct()


def has_exports(files: DataFrame, exports_: DataFrame, wildcards_: DataFrame) -> DataFrame:
    """Adds has_exports to files (file_id)."""
    any_ = exports_.select("file_id").union(wildcards_.select("file_id")).distinct().withColumn("has_exports", F.lit(True))
    return files.join(any_, "file_id", "left").withColumn("has_exports", F.coalesce("has_exports", F.lit(False)))


def linked_exports(exports_: DataFrame, wildcards_: DataFrame, files: DataFrame, extensions: list[str]) -> tuple[DataFrame, DataFrame]:
    """Exports and wildcards with target_file, the files that their modules name; files: file_id and path."""
    paths = files.select("file_id", "path")
    asked = exports_.where("src_module is not null").select("file_id", "src_module").union(wildcards_.select("file_id", "src_module")).distinct()
    asked = asked.join(paths, "file_id").withColumnRenamed("src_module", "module_path")
    found = settled(modules.resolve_specifiers(asked, paths, extensions).select("file_id", F.col("module_path").alias("src_module"), F.col("target_id").alias("target_file")))
    return exports_.join(found, ["file_id", "src_module"], "left"), wildcards_.join(found, ["file_id", "src_module"]).where("target_file is not null")


def imported(context: DataFrame, files: DataFrame, resolved: DataFrame, extensions: list[str]) -> DataFrame:
    """(file_id, alias, module, original, res_kind, res_name, defining_file): what names imported from other files of the workspace stand for.

    A name imported as its module's path is the default export.
    """
    paths = files.select("file_id", "path")
    asked = context.where(F.col("module").startswith("./") | F.col("module").startswith("../")).join(paths, "file_id").withColumnRenamed("module", "module_path")
    to = modules.resolve_specifiers(asked.select("path", "module_path").distinct(), paths, extensions)
    rows = asked.join(to, ["path", "module_path"]).withColumn("exported_name", F.when(F.col("original") == F.col("module_path"), "default").otherwise(F.col("original")))
    ends = resolved.select(F.col("file_id").alias("target_id"), "exported_name", "res_kind", "res_name", "defining_file")
    return rows.join(ends, ["target_id", "exported_name"]).select("file_id", "alias", F.col("module_path").alias("module"), "original", "res_kind", "res_name", "defining_file")


def namespace_import(resolved: DataFrame, targets: DataFrame) -> DataFrame:
    """(file_id, exported_name, res_name): all variables that a module imported as a whole gives; targets: file_id and target_id."""
    named = resolved.where("res_kind = 'EnvVar' and exported_name <> 'default'").select(F.col("file_id").alias("target_id"), "exported_name", "res_name")
    return targets.join(named, "target_id").select("file_id", "exported_name", "res_name")
