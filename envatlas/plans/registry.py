"""The registered queries of the engine's own operators, each with the SQL that it must equal.

The tables hold no source code, so corpora are made of their columns by expressions that Spark and SQL share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envatlas.functions import ranges, text
from envatlas.operators import locations, modules, scopes, symbols, values
from envatlas.sources import dotenv
from envatlas.streaming import index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


# Dotenv
@query("""SELECT n_regionkey AS file_id, upper(replace(n_name, ' ', '_')) AS key, CASE WHEN n_nationkey % 4 = 3 THEN '' ELSE 'v ' || n_nationkey END AS value FROM nation WHERE n_nationkey % 5 <> 4""")
def src04_dotenv(spark, sf_dir):
    k, name = F.col("n_nationkey"), F.upper(F.replace("n_name", F.lit(" "), F.lit("_")))
    line = F.when(k % 5 == 4, F.concat(F.lit("# "), name, F.lit("=no"))).when(k % 4 == 3, F.concat(name, F.lit("="))).when(k % 4 == 0, F.concat(name, F.lit('="v '), k, F.lit('"'))).when(k % 4 == 1, F.concat(F.lit("export "), name, F.lit("='v "), k, F.lit("' # said"))).otherwise(F.concat(name, F.lit("=v "), k, F.lit("   # said")))
    files = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("file_id")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n\n").alias("content"))
    return dotenv.keys(files).select("file_id", "key", "value")


@query("""SELECT c_custkey AS file_id, CASE c_custkey % 6 WHEN 0 THEN 'EDF999' WHEN 1 THEN 'EDF001' WHEN 2 THEN 'EDF003' WHEN 3 THEN 'EDF004' WHEN 4 THEN 'EDF005' ELSE 'EDF002' END AS code FROM customer""")
def qry09_env_errors(spark, sf_dir):
    k = F.col("c_custkey")
    kinds = ["BAD LINE", "KEY =v", "=v", "1KEY=v", 'KEY="v', "KEY==v"]
    files = table(spark, sf_dir, "customer").select(k.alias("file_id"), F.element_at(F.array(*map(F.lit, kinds)), (k % 6 + 1).cast("int")).alias("content"))
    return dotenv.entries(files).where("error_code is not null").select("file_id", F.col("error_code").alias("code"))


# Scalars
@query("SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z_][A-Za-z0-9_]*') AS a, regexp_full_match(replace(p_name, '#', '_'), '[A-Za-z_][A-Za-z0-9_]*') AS b FROM part")
def flt06_valid_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.is_variable_name(F.col("p_name")).alias("a"), text.is_variable_name(F.replace("p_name", F.lit("#"), F.lit("_"))).alias("b"))


@query("""SELECT doc_id, CAST(length(p) - length(replace(p, chr(10), '')) AS BIGINT) AS line, CAST(length(list_last(string_split(p, chr(10)))) AS BIGINT) AS col FROM (SELECT doc_id, substr(text, 1, CAST(n_chars // 2 AS INTEGER)) AS p FROM documents)""")
def txt_offset_linecol(spark, sf_dir):
    o = F.expr("n_chars div 2")
    return table(spark, sf_dir, "documents").select("doc_id", text.line_at(F.col("text"), o).cast("bigint").alias("line"), text.column_at(F.col("text"), o).cast("bigint").alias("col"))


@query("SELECT doc_id, CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '...' ELSE text END AS short FROM documents")
def lim02_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text")).alias("short"))


@query("SELECT l_orderkey, l_linenumber, CAST((l_suppkey % 7) * 10000 + CASE WHEN l_suppkey % 7 = 0 THEN (l_partkey % 50) + 5 - 5 ELSE (l_partkey % 50) + 5 END AS BIGINT) AS size FROM lineitem")
def rng_size(spark, sf_dir):
    sl, sc = F.lit(3), F.lit(5)
    el, ec = (F.col("l_suppkey") % 7 + 3), (F.col("l_partkey") % 50 + 5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ranges.size(sl, sc, el, ec).alias("size"))


@query("""SELECT a.l_orderkey, CAST(count(*) AS BIGINT) AS pairs FROM (SELECT l_orderkey, l_linenumber, l_partkey % 90 AS s, l_partkey % 90 + 1 + l_suppkey % 20 AS e FROM lineitem) a
    JOIN (SELECT l_orderkey, l_linenumber, l_partkey % 90 AS s, l_partkey % 90 + 1 + l_suppkey % 20 AS e FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.e > b.s AND b.e > a.s GROUP BY a.l_orderkey""")
def rng_overlap(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 90).alias("s"), (F.col("l_partkey") % 90 + 1 + F.col("l_suppkey") % 20).alias("e"))
    a, b = x.alias("a"), x.alias("b")
    hit = a.join(b, "l_orderkey").where(F.expr("a.l_linenumber < b.l_linenumber") & ranges.overlap(F.col("a.s"), F.col("a.e"), F.col("b.s"), F.col("b.e")))
    return hit.groupBy("l_orderkey").agg(F.count("*").alias("pairs"))


# Scopes and symbols
def _event_scopes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("scope_id"), F.col("event_id").alias("start"), (F.col("event_id") + 1 + F.floor(F.abs("value")) * 20).cast("bigint").alias("end"), (1 + F.floor(F.abs("value")) * 20).cast("bigint").alias("size"))


@query("""WITH s AS (SELECT user_id AS file_id, event_id AS scope_id, event_id AS a, event_id + 1 + CAST(floor(abs(value)) AS BIGINT) * 20 AS b, 1 + CAST(floor(abs(value)) AS BIGINT) * 20 AS size FROM events)
    SELECT p.event_id AS probe_id, coalesce(arg_min(s.scope_id, (s.size, s.scope_id)), 1) AS scope_id FROM events p LEFT JOIN s ON s.file_id = p.user_id AND p.event_id + 3 >= s.a AND p.event_id + 3 < s.b GROUP BY p.event_id""")
def scp03_scope_at(spark, sf_dir):
    probes = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("probe_id"), (F.col("event_id") + 3).alias("at"))
    return scopes.scope_at(probes, _event_scopes(spark, sf_dir)).select("probe_id", F.col("scope_id").cast("bigint").alias("scope_id"))


def _supplier_scopes(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where("s_suppkey > 0").select(F.lit(0).cast("bigint").alias("file_id"), F.col("s_suppkey").alias("scope_id"), F.expr("s_suppkey div 2").alias("parent_id"))


_CLOSURE = """up(scope_id, ancestor_id, depth) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT up.scope_id, s.s_suppkey // 2, depth + 1 FROM up JOIN supplier s ON s.s_suppkey = up.ancestor_id AND s.s_suppkey > 0)"""


@query(f"WITH RECURSIVE {_CLOSURE} SELECT scope_id, ancestor_id, CAST(depth AS BIGINT) AS depth FROM up")
def scp05_scope_closure(spark, sf_dir):
    return scopes.closure(_supplier_scopes(spark, sf_dir)).select("scope_id", "ancestor_id", F.col("depth").cast("bigint").alias("depth"))


def _order_symbols(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey").alias("m"))
    o = table(spark, sf_dir, "orders").crossJoin(F.broadcast(s))  # one row
    return o.select(F.lit(0).cast("bigint").alias("file_id"), F.col("o_orderkey").alias("symbol_id"), F.concat(F.lit("n"), F.col("o_custkey") % 40).alias("name"), (F.col("o_orderkey") % F.col("m") + 1).alias("scope_id"), (F.col("o_orderstatus") != "F").alias("is_valid"), (F.col("o_orderkey") % 1000).alias("decl_end"))


_SYMBOLS = "sym AS (SELECT o_orderkey AS symbol_id, 'n' || (o_custkey % 40) AS name, o_orderkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS scope_id, o_orderstatus <> 'F' AS is_valid, o_orderkey % 1000 AS decl_end FROM orders)"
_LOOKUP = "look AS (SELECT p.c_custkey AS probe_id, arg_min(symbol_id, (depth, -symbol_id)) AS symbol_id FROM customer p JOIN up ON up.scope_id = p.c_custkey % (SELECT max(s_suppkey) FROM supplier) + 1 JOIN sym ON sym.scope_id = up.ancestor_id AND sym.name = 'n' || (p.c_nationkey * 2) AND sym.is_valid GROUP BY 1)"


def _probes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey").alias("m"))
    c = table(spark, sf_dir, "customer").crossJoin(F.broadcast(s))  # one row
    return c.select(F.lit(0).cast("bigint").alias("file_id"), F.col("c_custkey").alias("probe_id"), F.concat(F.lit("n"), F.col("c_nationkey") * 2).alias("name"), (F.col("c_custkey") % F.col("m") + 1).alias("scope_id"), (F.col("c_custkey") % 900).alias("at"))


@query(f"WITH RECURSIVE {_CLOSURE}, {_SYMBOLS}, {_LOOKUP} SELECT c_custkey AS probe_id, look.symbol_id FROM customer LEFT JOIN look ON look.probe_id = c_custkey")
def jn01_lookup_symbol(spark, sf_dir):
    c = scopes.closure(_supplier_scopes(spark, sf_dir))
    return symbols.lookup(_probes(spark, sf_dir), c, _order_symbols(spark, sf_dir)).select("probe_id", "symbol_id")


@query(f"WITH RECURSIVE {_CLOSURE}, {_SYMBOLS}, {_LOOKUP} SELECT probe_id, look.symbol_id FROM look JOIN sym USING (symbol_id) WHERE probe_id % 900 > decl_end")
def jn03_usages(spark, sf_dir):
    c = scopes.closure(_supplier_scopes(spark, sf_dir))
    return symbols.usages(_probes(spark, sf_dir), c, _order_symbols(spark, sf_dir)).select("probe_id", "symbol_id")


@query(f"""WITH RECURSIVE {_CLOSURE}, {_SYMBOLS}, re AS (SELECT DISTINCT 'n' || (p_size % 40) AS name, p_partkey % 30 + 1 AS scope_id FROM part WHERE p_size < 6)
    SELECT symbol_id, is_valid AND NOT EXISTS (SELECT 1 FROM up JOIN re ON re.scope_id = up.ancestor_id WHERE up.scope_id = sym.scope_id AND re.name = sym.name) AS is_valid FROM sym""")
def jn08_invalidate(spark, sf_dir):
    c = scopes.closure(_supplier_scopes(spark, sf_dir))
    again = table(spark, sf_dir, "part").where("p_size < 6").select(F.lit(0).cast("bigint").alias("file_id"), F.concat(F.lit("n"), F.col("p_size") % 40).alias("name"), (F.col("p_partkey") % 30 + 1).alias("scope_id"))
    return symbols.invalidated(_order_symbols(spark, sf_dir), again, c).select("symbol_id", "is_valid")


_CHAIN = """c AS (SELECT o_orderkey AS id, o_orderkey - 1 AS target, CASE WHEN o_orderkey % 16 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'EnvVar' ELSE 'EnvObject' END WHEN o_orderkey % 5 = 0 THEN 'Destructured' ELSE 'Symbol' END AS kind, 'K' || o_orderkey AS own FROM orders)"""


@query(f"""WITH RECURSIVE {_CHAIN}, w(id, node, n, keys, key) AS (SELECT id, id, 1, 0, NULL::VARCHAR FROM c UNION ALL
    SELECT w.id, c.target, n + 1, keys + CAST(c.kind = 'Destructured' AS INTEGER), CASE WHEN c.kind = 'Destructured' AND key IS NULL THEN c.own ELSE key END FROM w JOIN c ON c.id = w.node WHERE c.kind IN ('Symbol', 'Destructured') AND n < 40),
    e AS (SELECT w.id, CASE WHEN n > 10 THEN NULL WHEN keys = 0 AND c.kind = 'EnvVar' THEN 'Variable' WHEN keys = 0 AND c.kind = 'EnvObject' THEN 'Object' WHEN keys = 1 AND c.kind = 'EnvObject' THEN 'Variable' END AS kind, CASE WHEN keys = 1 THEN key ELSE c.own END AS name FROM w JOIN c ON c.id = w.node AND c.kind IN ('EnvVar', 'EnvObject'))
    SELECT c.id AS symbol_id, e.kind AS resolved_kind, CASE WHEN e.kind IS NOT NULL THEN e.name END AS resolved_name FROM c LEFT JOIN e ON e.id = c.id""")
def rec01_resolve(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.when(k % 16 == 0, F.when(F.col("o_orderstatus") == "F", "EnvVar").otherwise("EnvObject")).when(k % 5 == 0, "Destructured").otherwise("Symbol")
    s = table(spark, sf_dir, "orders").select(F.lit(0).alias("file_id"), k.alias("symbol_id"), kind.alias("origin_kind"), F.concat(F.lit("K"), k).alias("origin_name"), (k - 1).alias("origin_target"), F.concat(F.lit("K"), k).alias("origin_key"))
    return symbols.resolve(s).select("symbol_id", "resolved_kind", "resolved_name")


# Locations and aggregates
def _locations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("file_id"), F.concat(F.lit("V"), F.col("l_suppkey") % 60).alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_partkey") % 200).alias("sl"), (F.col("l_suppkey") % 10).alias("sc"), (F.col("l_partkey") % 200).alias("el"), (F.col("l_suppkey") % 10 + 4).alias("ec"), "l_returnflag")
    kinds = {"A": locations.PHASES[0], "N": locations.PHASES[1], "R": locations.PHASES[2]}
    return locations.locations(*[li.where(F.col("l_returnflag") == f).withColumn("kind", F.lit(k)) for f, k in kinds.items()])


_LOCATIONS = """loc AS (SELECT l_orderkey % 500 AS file_id, l_partkey % 200 AS sl, l_suppkey % 10 AS sc, arg_min('V' || (l_suppkey % 60), (l_returnflag, l_orderkey * 10 + l_linenumber, 'V' || (l_suppkey % 60))) AS name,
    CASE min(l_returnflag) WHEN 'A' THEN 'DirectReference' WHEN 'N' THEN 'BindingDeclaration' ELSE 'BindingUsage' END AS kind FROM lineitem GROUP BY 1, 2, 3)"""


@query(f"WITH {_LOCATIONS} SELECT * FROM loc")
def loc01_locations(spark, sf_dir):
    return _locations(spark, sf_dir).select("file_id", "sl", "sc", "name", "kind")


@query(f"WITH {_LOCATIONS} SELECT DISTINCT name FROM loc")
def agg01_all_vars(spark, sf_dir):
    return _locations(spark, sf_dir).select("name").distinct()


@query(f"WITH {_LOCATIONS} SELECT DISTINCT name, file_id FROM loc")
def agg02_env_to_files(spark, sf_dir):
    return locations.files_by_variable(_locations(spark, sf_dir))


@query(f"WITH {_LOCATIONS} SELECT (SELECT count(*) FROM orders) AS total_files, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS env_files, (SELECT count(DISTINCT name) FROM loc) AS total_env_vars")
def agg05_stats(spark, sf_dir):
    return locations.stats(table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "O").alias("is_env")), locations.files_by_variable(_locations(spark, sf_dir)))


@query("SELECT o_orderkey, CAST(CASE WHEN o_custkey % 9 = 0 THEN 100 ELSE least(100, ((o_orderkey % 13) * 100) // (o_custkey % 9)) END AS INTEGER) AS percent FROM orders")
def agg06_progress(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", locations.progress(F.col("o_orderkey") % 13, F.col("o_custkey") % 9).alias("percent"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey) <= 2")
def agg09_line_cap(spark, sf_dir):
    return locations.capped(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_partkey", "l_linenumber", "l_suppkey"], 2).select("l_orderkey", "l_linenumber")


# Values
def _values(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("Shell").alias("source"), F.lit(None).cast("string").alias("source_path"), F.lit(0).alias("file_rank"), F.concat(F.lit("K"), F.col("c_custkey") % 300).alias("key"), F.concat(F.lit("c"), F.col("c_custkey") % 300).alias("value"))
    s = table(spark, sf_dir, "supplier").select(F.lit("Remote"), F.lit("vault"), F.lit(0), F.concat(F.lit("K"), F.col("s_suppkey") * 5), F.concat(F.lit("s"), F.col("s_suppkey")))
    p = table(spark, sf_dir, "part").select(F.lit("File"), F.concat(F.lit(".env"), F.col("p_partkey") % 2), (F.col("p_partkey") % 2).cast("int"), F.concat(F.lit("K"), F.expr("p_partkey div 2")), F.concat(F.lit("p"), F.col("p_partkey")))
    return c.distinct().union(s).union(p)


_VALUES = """v AS (SELECT DISTINCT 'Shell' AS source, NULL AS path, 0 AS r, 'K' || (c_custkey % 300) AS key, 'c' || (c_custkey % 300) AS value FROM customer UNION ALL SELECT 'Remote', 'vault', 0, 'K' || (s_suppkey * 5), 's' || s_suppkey FROM supplier
    UNION ALL SELECT 'File', '.env' || (p_partkey % 2), p_partkey % 2, 'K' || (p_partkey // 2), 'p' || p_partkey FROM part)"""
_MERGED = f"{_VALUES}, m AS (SELECT key, value, source FROM v WHERE source <> 'Remote' QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE source WHEN 'File' THEN 0 ELSE 1 END, r DESC) = 1)"


def _used_name():
    c = F.col("o_custkey")
    return F.when(c % 7 == 0, F.concat(F.lit("U"), c % 50)).otherwise(F.concat(F.lit("K"), (c * 3) % 700))


def _merged(spark, sf_dir):
    return values.merged(_values(spark, sf_dir), spark.createDataFrame([("File", 0), ("Shell", 1)], "source string, source_rank int"))


@query(f"WITH {_MERGED} SELECT * FROM m")
def val03_precedence(spark, sf_dir):
    return _merged(spark, sf_dir).select("key", "value", "source")


@query("SELECT n_name AS key, 'x-' || n_nationkey || '-r' || n_regionkey || '/' || r_name || '/' AS value FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'R' || r_regionkey, 'r' || r_regionkey || '/' || r_name FROM region UNION ALL SELECT 'N' || r_regionkey, r_name FROM region")
def rec05_interpolation(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.concat(F.lit("x-"), F.col("n_nationkey"), F.lit("-${R"), F.col("n_regionkey"), F.lit("}/${NONE}")).alias("value"))
    r = table(spark, sf_dir, "region")
    a = r.select(F.concat(F.lit("R"), F.col("r_regionkey")), F.concat(F.lit("r"), F.col("r_regionkey"), F.lit("/${N"), F.col("r_regionkey"), F.lit("}")))
    b = r.select(F.concat(F.lit("N"), F.col("r_regionkey")), "r_name")
    return values.interpolated(n.union(a).union(b))


@query(f"WITH {_MERGED} SELECT DISTINCT CASE WHEN o_custkey % 7 = 0 THEN 'U' || (o_custkey % 50) ELSE 'K' || ((o_custkey * 3) % 700) END AS name FROM orders WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.key = CASE WHEN o_custkey % 7 = 0 THEN 'U' || (o_custkey % 50) ELSE 'K' || ((o_custkey * 3) % 700) END)")
def jn16_undefined(spark, sf_dir):
    used = table(spark, sf_dir, "orders").select(_used_name().alias("name")).distinct()
    return values.undefined(used, _merged(spark, sf_dir))


@query(f"WITH {_MERGED} SELECT key FROM m WHERE NOT EXISTS (SELECT 1 FROM orders WHERE m.key = CASE WHEN o_custkey % 7 = 0 THEN 'U' || (o_custkey % 50) ELSE 'K' || ((o_custkey * 3) % 700) END)")
def set02_unused(spark, sf_dir):
    used = table(spark, sf_dir, "orders").select(_used_name().alias("name")).distinct()
    return values.unused(_merged(spark, sf_dir), used).select("key")


@query("SELECT 'K' || (p_partkey % 97) AS key, arg_min(p_partkey % 5, (p_size, p_partkey, p_partkey % 5)) AS file_id, arg_min(p_partkey, (p_size, p_partkey)) AS ord FROM part GROUP BY 1")
def jn17_definition(spark, sf_dir):
    return values.first_definition(table(spark, sf_dir, "part").select(F.concat(F.lit("K"), F.col("p_partkey") % 97).alias("key"), F.col("p_size").alias("file_rank"), F.col("p_partkey").alias("ord"), (F.col("p_partkey") % 5).alias("file_id")))


@query(f"WITH {_MERGED} SELECT key || '=' AS line FROM (SELECT key FROM m UNION SELECT CASE WHEN o_custkey % 7 = 0 THEN 'U' || (o_custkey % 50) ELSE 'K' || ((o_custkey * 3) % 700) END FROM orders)")
def set01_env_example(spark, sf_dir):
    used = table(spark, sf_dir, "orders").select(_used_name().alias("name"))
    return values.example(used.union(_merged(spark, sf_dir).select("key")))


@query(f"WITH {_VALUES}, k(source, priority, enabled) AS (VALUES ('Shell', 100, TRUE), ('File', 50, TRUE), ('Remote', 25, FALSE)) SELECT source, CAST(priority AS INTEGER) AS priority, (SELECT count(*) FROM v WHERE v.source = k.source) AS n, enabled FROM k")
def agg08_source_list(spark, sf_dir):
    kinds = spark.createDataFrame([("Shell", 100, True), ("File", 50, True), ("Remote", 25, False)], "source string, priority int, enabled boolean")
    return values.source_counts(_values(spark, sf_dir), kinds)


# Modules
@query("""SELECT 'src/r' || n_regionkey || '/n' || n_nationkey || '.js' AS path, spec AS module_path, target FROM (SELECT *, CASE n_nationkey % 4 WHEN 0 THEN '../lib/m' || n_regionkey WHEN 1 THEN './n' || (n_nationkey - 1) ELSE CASE n_nationkey % 4 WHEN 2 THEN '../../../up' ELSE 'pkg' END END AS spec,
    CASE n_nationkey % 4 WHEN 0 THEN 1000 + n_regionkey WHEN 1 THEN (SELECT b.n_nationkey FROM nation b WHERE b.n_nationkey = nation.n_nationkey - 1 AND b.n_regionkey = nation.n_regionkey) END AS target FROM nation)""")
def jn12_module_resolve(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    path = F.concat(F.lit("src/r"), F.col("n_regionkey"), F.lit("/n"), F.col("n_nationkey"), F.lit(".js"))
    k = F.col("n_nationkey") % 4
    spec = F.when(k == 0, F.concat(F.lit("../lib/m"), F.col("n_regionkey"))).when(k == 1, F.concat(F.lit("./n"), F.col("n_nationkey") - 1)).when(k == 2, "../../../up").otherwise("pkg")
    files = n.select(path.alias("path"), F.col("n_nationkey").alias("file_id")).union(table(spark, sf_dir, "region").select(F.concat(F.lit("src/lib/m"), F.col("r_regionkey"), F.lit("/index.ts")), F.col("r_regionkey") + 1000))
    out = modules.resolve_specifiers(n.select(path.alias("path"), spec.alias("module_path")), files, ["js", "ts"])
    return out.select("path", "module_path", F.col("target_id").cast("int").alias("target"))


@query("""WITH RECURSIVE x AS (SELECT s_suppkey AS f, 'N' || (s_suppkey % 7) AS name, s_suppkey % 3 AS k FROM supplier), f(file, name, def, depth, way) AS (SELECT f, name, f, 0, CAST([] AS INTEGER[]) FROM x WHERE k = 0 UNION ALL
    SELECT t.file, t.name, t.def, t.depth + 1, t.way FROM (
        SELECT x.f AS file, x.name, f.def, f.depth, f.way FROM f JOIN x ON x.k = 1 AND x.f // 2 = f.file AND f.name = 'N' || ((x.f // 2) % 7)
        UNION ALL SELECT x.f, f.name, f.def, f.depth, list_concat([CAST(w.o AS INTEGER)], f.way) FROM f JOIN x ON x.k = 2 JOIN (VALUES (0), (1)) w(o) ON f.file = CASE w.o WHEN 0 THEN x.f // 2 ELSE x.f // 3 END) t WHERE t.depth < 9)
    SELECT file AS file_id, name AS exported_name, arg_min('E' || def, (way, depth)) AS res_name, arg_min(def, (way, depth)) AS defining_file FROM f GROUP BY 1, 2""")
def rec02_cross_module(spark, sf_dir):
    k, s = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    half = F.expr("s_suppkey div 2")
    kind = F.when(k % 3 == 0, "EnvVar").otherwise("ReExport")
    exports = s.where("s_suppkey % 3 < 2").select(k.alias("file_id"), F.concat(F.lit("N"), k % 7).alias("exported_name"), kind.alias("res_kind"), F.concat(F.lit("E"), k).alias("res_name"), half.alias("target_file"), F.concat(F.lit("N"), half % 7).alias("orig_name"))
    wild = s.where("s_suppkey % 3 = 2").select(k.alias("file_id"), F.posexplode(F.array(half, F.expr("s_suppkey div 3"))).alias("ord", "target_file"))
    return modules.resolve_exports(exports, wild).select("file_id", "exported_name", "res_name", "defining_file")


@query("SELECT n_regionkey AS file_id, 'X' || (n_nationkey % 3) AS exported_name, max(n_nationkey) AS ord FROM nation GROUP BY 1, 2")
def dst02_last_export(spark, sf_dir):
    return modules.last_exports(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("file_id"), F.concat(F.lit("X"), F.col("n_nationkey") % 3).alias("exported_name"), F.col("n_nationkey").alias("ord")))


# Incremental
@query("""SELECT user_id, first_edit, version, edits FROM (SELECT user_id, burst, min(ts) AS first_edit, max(event_id) AS version, count(*) AS edits FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2)""")
def str01_debounce(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("uri"), "ts", F.col("event_id").alias("version"), F.col("event_type").alias("content"))
    return index.debounced(e, "6 hours").select(F.col("uri").alias("user_id"), "first_edit", "version", "edits")


@query("SELECT o_orderkey AS file_id FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0")
def str05_stale(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderdate").alias("mtime"))
    old = o.where("file_id % 7 <> 0").withColumn("mtime", F.when(F.col("file_id") % 5 == 0, F.col("mtime") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("mtime")))
    return index.stale(o, old).select("file_id")


@query("SELECT DISTINCT l_orderkey AS file_id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 50")
def str07_dirty(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_partkey").alias("target_id"))
    return index.dirty(table(spark, sf_dir, "part").where("p_size = 50").select(F.col("p_partkey").alias("file_id")), edges)


@query("SELECT l_orderkey AS file_id, l_partkey AS target_id FROM lineitem WHERE l_orderkey % 9 <> 0 AND l_partkey % 9 <> 0")
def str08_remove_files(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_partkey").alias("target_id"))
    both = li.select("file_id").union(li.select("target_id"))
    return index.without_files(li, both.where("file_id % 9 = 0"))


@query("SELECT o_custkey AS uri, arg_max(o_orderkey, (o_orderkey)) AS version FROM orders GROUP BY 1 HAVING arg_max(o_orderstatus, o_orderkey) <> 'F'")
def str04_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    e = o.select(F.col("o_custkey").alias("uri"), F.when(F.col("o_orderstatus") == "F", "close").otherwise("change").alias("op"), F.col("o_orderpriority").alias("content"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("ts"))
    return index.latest(e).select("uri", "version")
