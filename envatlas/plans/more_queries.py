"""Queries of the smaller operators: filters, cursors, paths, env files' errors and what follows from settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from envatlas.functions import ranges, text
from envatlas.operators import endpoints, filters, locations, workspace
from envatlas.plans.index_queries import _names, _session, indexed, the_index
from envatlas.plans.registry import query, table
from envatlas.sources import dotenv, extract
from envatlas.streaming import index as streaming


def _paths(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, (".env", ".env.local", "x.js", ".env.prod"))), (k % 4 + 1).cast("int"))
    folder = F.when(k % 5 == 0, "/w/").otherwise(F.concat(F.lit("/w/p"), k % 40, F.lit("/d"), k, F.lit("/")))
    return table(spark, sf_dir, "part").select(k.alias("n"), F.concat(folder, name).alias("path"))


_PATHS = "paths AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 5 = 0 THEN '/w/' ELSE '/w/p' || (p_partkey % 40) || '/d' || p_partkey || '/' END || CASE p_partkey % 4 WHEN 0 THEN '.env' WHEN 1 THEN '.env.local' WHEN 2 THEN 'x.js' ELSE '.env.prod' END AS path FROM part)"


@query(f"WITH {_PATHS} SELECT n, CASE n % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS file_rank FROM paths WHERE n % 4 <> 2")
def src03_env_files(spark, sf_dir):
    return workspace.env_files(_paths(spark, sf_dir), [".env", ".env.local", ".env.*"]).select("n", "file_rank")


@query(f"WITH {_PATHS} SELECT n FROM paths WHERE n % 4 = 1 OR path = '/w/.env'")
def flt10_active_files(spark, sf_dir):
    return workspace.active(_paths(spark, sf_dir), [".env.l*", "/w/.env"]).select("n")


@query(f"WITH {_PATHS} SELECT n FROM paths WHERE path LIKE '/w/p7/%' OR n % 5 = 0")
def flt11_package_files(spark, sf_dir):
    return workspace.package_files(_paths(spark, sf_dir), "/w/p7", "/w").select("n")


@query(f"WITH {_PATHS} SELECT n, CASE WHEN n % 5 = 0 THEN substr(path, 4) WHEN path LIKE '/w/p7/%' THEN substr(path, 4) ELSE substr(path, 4) END AS inside, CASE WHEN path LIKE '/w/p7/%' THEN substr(path, 7) ELSE list_last(string_split(path, '/')) END AS other FROM paths")
def flt12_relative_paths(spark, sf_dir):
    return _paths(spark, sf_dir).select("n", workspace.relative(F.col("path"), "/w").alias("inside"), workspace.relative(F.col("path"), "/w/p7").alias("other"))


@query("SELECT p_partkey, 'K' || p_partkey AS name, 'K' || p_partkey AS key FROM part")
def ext16_names_and_keys(spark, sf_dir):
    k = F.concat(F.lit("K"), F.col("p_partkey"))
    quoted = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(' "'), k, F.lit('" '))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("'"), k, F.lit("'"))).otherwise(F.concat(F.lit("`"), k, F.lit("`")))
    pair = F.concat(F.lit(" "), k, F.when(F.col("p_partkey") % 2 == 0, ": local").otherwise(" "))
    return table(spark, sf_dir, "part").select("p_partkey", filters.extracted_name(quoted, "\"'`").alias("name"), filters.destructured_key(pair).alias("key"))


#: (language, line, what completes there, the object and property under the cursor); the cursor stands at |.
_CURSORS = (
    ("javascript", "x = process.env.|", "process.env", None, None), ("javascript", "x = process.env['|", "process.env", None, None), ("javascript", "y = env.PO|RT;", "env", "env", "PORT"), ("javascript", "// process.env.|", None, None, None), ("javascript", "f(|)", None, None, None), ("typescript", "import.meta.env.|", "import.meta.env", None, None),
    ("python", "os.environ['|", "os.environ", None, None), ("python", "os.getenv('|", "os", None, None), ("python", "x = env['K|']", "env", "env", "K"), ("go", 'os.Getenv("|', "os", None, None), ("rust", 'std::env::var("|', "std::env", None, None), ("java", 'System.getenv("|', "System", None, None), ("bash", "echo ${|", "$", None, None), ("ruby", "ENV['|", "ENV", None, None), ("php", "$_ENV['|", "$_ENV", None, None), ("zig", 'std.posix.getenv("|', "std", None, None),
)


def _sql_text(x) -> str:
    return "NULL::VARCHAR" if x is None else "'" + x.replace("'", "''") + "'"


@query(f"SELECT p_partkey AS probe_id, c.context, c.object, c.property FROM part JOIN (VALUES {', '.join(f'({i}, ' + ', '.join(map(_sql_text, c[2:])) + ')' for i, c in enumerate(_CURSORS))}) c(i, context, object, property) ON p_partkey % {len(_CURSORS)} = c.i")
def ext04_cursor_context(spark, sf_dir):
    kinds = spark.createDataFrame([(i, lang, line.replace("|", ""), line.index("|")) for i, (lang, line, *_) in enumerate(_CURSORS)], "i int, lang string, said string, character int")
    parts = table(spark, sf_dir, "part").withColumn("i", (F.col("p_partkey") % len(_CURSORS)).cast("int")).join(F.broadcast(kinds), "i")  # one row a kind
    contents = parts.select(F.col("p_partkey").alias("file_id"), "lang", F.concat(F.lit("first line\n"), "said", F.lit("\nlast line")).alias("content"))
    probes = parts.select(F.col("p_partkey").alias("file_id"), F.col("p_partkey").alias("probe_id"), F.lit(1).alias("line"), "character")
    return extract.by_cursor(probes, contents).select("probe_id", "context", "object", "property")


@query("SELECT n_nationkey AS file_id, 'V' || n_nationkey AS name FROM nation WHERE n_nationkey % 3 <> 2")
def jn09_alias_validation(spark, sf_dir):
    k = F.col("n_nationkey").cast("string")
    lead = F.when(F.col("n_nationkey") % 3 == 0, "from os import environ as e\n").when(F.col("n_nationkey") % 3 == 1, "from dotenv import x as e\n").otherwise("from other import environ as e\n")
    files = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("file_id"), F.lit("python").alias("lang"), F.concat(lead, F.lit("y = e['V"), k, F.lit("']\n")).alias("content"))
    return extract.extract(files, use_imports=True).where("kind = 'reference'").select(F.col("file_id").cast("int").alias("file_id"), "name")


_LINES = ("BAD LINE", "  KEY =v", "=v", "1KEY=v", 'KEY="v', "KEY==v", "KEY=a�b", "OK=1")


@query("SELECT c_custkey AS file_id, x.code, CASE WHEN x.code = 'EDF006' THEN 'WARNING' ELSE 'ERROR' END AS severity, 1 AS sl, x.sc FROM customer JOIN (VALUES (0, 'EDF999', 0), (1, 'EDF001', 5), (2, 'EDF003', 0), (3, 'EDF004', 0), (4, 'EDF005', 0), (5, 'EDF002', 4), (6, 'EDF006', 5)) x(i, code, sc) ON c_custkey % 8 = x.i")
def qry09_env_diagnostics(spark, sf_dir):
    k = F.col("c_custkey")
    line = F.element_at(F.array(*map(F.lit, _LINES)), (k % 8 + 1).cast("int"))
    files = table(spark, sf_dir, "customer").select(k.alias("file_id"), F.concat(F.lit("A=1\n"), line, F.lit("\nB='x\ny'")).alias("content"))
    return endpoints.env_diagnostics(dotenv.entries(files)).where("sl = 1").select("file_id", "code", "severity", "sl", "sc")


@query("SELECT c_custkey AS file_id, 'B' AS key, 'x' || chr(10) || 'y' || c_custkey AS value, 1 AS sl FROM customer UNION ALL SELECT c_custkey, 'C', 'z', 3 FROM customer")
def val05_multi_line_values(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.concat(F.lit("# A=1\nB=\"x\ny"), F.col("c_custkey"), F.lit('" # said\nexport C=z')).alias("content"))
    return dotenv.entries(files).where("not is_comment").select("file_id", "key", "value", "sl")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '**`A`**' ELSE '**`a`** → **`A`**' END || chr(10) || chr(10) || '**Value**: ' || CASE c_custkey % 3 WHEN 0 THEN '*(empty)*' WHEN 1 THEN '`x`' || chr(10) || '`y`' ELSE '`' || c_name || '`' END || chr(10) || chr(10) || '**Source**: `.env`' || CASE c_custkey % 5 WHEN 0 THEN chr(10) || chr(10) || '*d*' ELSE '' END AS markdown FROM customer")
def val11_hover_text(spark, sf_dir):
    k = F.col("c_custkey")
    value = F.when(k % 3 == 0, "").when(k % 3 == 1, "x\ny").otherwise(F.col("c_name"))
    source = text.source_name(F.lit("File"), F.lit("/w/.env"), F.lit(""))
    shown = endpoints.hover_text(F.lit("A"), F.when(k % 4 == 0, "A").otherwise("a"), value, source, F.when(k % 5 == 0, "d"))
    return table(spark, sf_dir, "customer").select("c_custkey", shown.alias("markdown"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN 'v' || l_partkey END AS variable, CASE WHEN l_suppkey % 3 = 1 THEN 'v' || l_partkey END AS object, l_suppkey % 4 < 2 AS shown FROM lineitem")
def flt03_projections(spark, sf_dir):
    kind = F.when(F.col("l_suppkey") % 3 == 0, "Variable").when(F.col("l_suppkey") % 3 == 1, "Object")
    name = F.concat(F.lit("v"), F.col("l_partkey"))
    at = F.element_at(F.array(*map(F.lit, locations.PHASES)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", filters.as_variable(kind, name).alias("variable"), filters.as_object(kind, name).alias("object"), filters.shown(at, ("DirectReference", "BindingDeclaration")).alias("shown"))


@query("SELECT l_orderkey AS importer, l_partkey AS target_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' AND l_partkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def str09_kept_resolutions(spark, sf_dir):
    cache = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("importer"), F.col("l_partkey").alias("target_id"))
    return streaming.kept_cache(cache, table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("file_id")))


@query("SELECT user_id AS uri, min(event_id) AS sl, max(event_id) + 1 AS el FROM events GROUP BY 1")
def str03_edit_ranges(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("uri"), F.col("event_id").alias("sl"), F.lit(0).alias("sc"), (F.col("event_id") + 1).alias("el"), F.lit(0).alias("ec"))
    return streaming.edit_ranges(e).select("uri", "sl", "el")


@query("SELECT c_custkey AS file_id, s_suppkey AS symbol_id FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE NOT (s_suppkey % 90 + 4 > c_custkey % 50 AND c_custkey % 50 + 9 > s_suppkey % 90)")
def str10_symbols_outside_ranges(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").repartition("c_custkey"), table(spark, sf_dir, "supplier")  # dealt by file while there is a row a file
    symbols = c.join(s, c["c_nationkey"] == s["s_nationkey"]).select(F.col("c_custkey").alias("file_id"), F.col("s_suppkey").alias("symbol_id"), (F.col("s_suppkey") % 90).alias("start"), (F.col("s_suppkey") % 90 + 4).alias("end"))
    edits = c.select(F.col("c_custkey").alias("file_id"), (F.col("c_custkey") % 50).alias("start"), (F.col("c_custkey") % 50 + 9).alias("end"))
    none = symbols.limit(0).withColumn("usage_id", F.lit(0))
    return streaming.without_ranges(symbols, none, edits)[0].select("file_id", "symbol_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity < 20 AS holds, l_quantity > 30 AS inside FROM lineitem")
def rng_contains(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ranges.contains_position(ranges.point(F.lit(0), F.lit(0)), ranges.point(F.lit(20), F.lit(0)), ranges.point(q, F.lit(0))).alias("holds"), ranges.contains_range(F.lit(30), F.lit(99), q - 1, q).alias("inside"))


# On the made workspace
@indexed("SELECT file_id, count(*) AS n FROM (SELECT file_id FROM loc WHERE kind <> 'BindingUsage' UNION ALL SELECT file_id FROM def) GROUP BY 1")
def snk03_workspace_edit(spark, sf_dir):
    idx = the_index(spark, sf_dir)
    edits = endpoints.workspace_edit(idx.rename(_names(idx).select(F.col("name").alias("old"), F.lit("NEW").alias("new_text"))))
    return edits.groupBy("file_id").agg(F.sum(F.size("edits")).alias("n"))


@indexed("SELECT 'V6' AS name, 0 AS file_id UNION ALL SELECT 'V6', -1 UNION ALL SELECT 'X5', 0")
def jn15_files_for_env_var(spark, sf_dir):
    return filters.files_for(the_index(spark, sf_dir).env_to_files, ["V6", "X5", "NONE"])


@indexed("SELECT key AS name, value FROM def WHERE f = 0")
def val06_active_patterns(spark, sf_dir):
    s = _session(spark, sf_dir)
    s.run("source.setPrecedence", "file")
    s.run("file.setActive", "e0/.env")
    return s.run("listEnvVariables").select("name", "value")


@indexed("SELECT f AS file_id FROM n GROUP BY f HAVING count_if(form = 5) = 0 UNION ALL SELECT DISTINCT file_id FROM def")
def flt04_files_without_exports(spark, sf_dir):
    from envatlas.operators import graph

    idx = the_index(spark, sf_dir)
    return filters.is_exports_empty(idx.classified.select("file_id"), idx.exports, graph.wildcards(idx.graph))
