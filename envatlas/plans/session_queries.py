"""Queries of what a session keeps up to date: open documents, the index after watched changes, what clients are told, and the workspace's own figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from envatlas.functions.settled import shared_folder
from envatlas.operators import values
from envatlas.plans import stored
from envatlas.plans.index_queries import indexed, the_index, workspace_files
from envatlas.plans.registry import query, table
from envatlas.streaming import index as streaming


@query("SELECT user_id AS uri, max(event_id) AS version, arg_max(props, event_id) AS content FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def src08_open_documents(spark, sf_dir):
    """A document is closed by its latest event, an error, or open with the text of that event."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "close").otherwise("change")
    return streaming.open_documents(e.select(F.col("user_id").alias("uri"), "ts", op.alias("op"), F.col("event_id").alias("version"), F.col("props").alias("content")))


_ACTIONS = """last AS (SELECT o_custkey AS path, arg_max(o_orderstatus, (o_orderdate, o_orderstatus)) AS status FROM orders GROUP BY 1),
  act AS (SELECT path, CASE WHEN status = 'F' THEN 'remove' WHEN CAST(path AS VARCHAR) LIKE '%0' THEN 'refresh' ELSE 'index' END AS action FROM last)"""


def _actions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "delete").when(F.col("o_orderstatus") == "O", "change").otherwise("create")
    events = o.select(F.col("o_custkey").cast("string").alias("path"), kind.alias("type"), F.struct("o_orderdate", "o_orderstatus").alias("ts"))
    return streaming.watched_changes(events, lambda p: p.endswith("0"))


@query(f"WITH {_ACTIONS} SELECT c_custkey AS path, CASE WHEN action IS NULL THEN 'old ' ELSE 'new ' END || c_name AS name FROM customer LEFT JOIN act ON path = c_custkey WHERE action IS NULL OR action <> 'remove'")
def src09_index_after_changes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), "c_name")
    old, fresh = (c.select("path", F.concat(F.lit(word), "c_name").alias("name")) for word in ("old ", "new "))
    return streaming.after_changes(old, _actions(spark, sf_dir), fresh).select(F.col("path").cast("bigint").alias("path"), "name")


@query(f"WITH {_ACTIONS} SELECT 'log' AS kind, action || ': ' || path AS message FROM act UNION ALL SELECT 'refresh-hints', '' WHERE EXISTS (SELECT 1 FROM act WHERE action = 'refresh')")
def snk02_notifications(spark, sf_dir):
    return streaming.notifications(_actions(spark, sf_dir))


@query("SELECT key, file_id, ord FROM (SELECT l_partkey AS key, l_orderkey AS file_id, l_linenumber AS ord, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey % 3, l_linenumber, l_orderkey) AS r FROM lineitem) WHERE r = 1")
def lim01_first_definition(spark, sf_dir):
    """Of many definitions of a key the first, without ordering them: one row a key and task is shuffled."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("ord"), (F.col("l_suppkey") % 3).alias("file_rank"))
    return values.first_definition(rows).select("key", "file_id", "ord")


@indexed("""SELECT f.file_id, count(d.file_id) AS n FROM (SELECT DISTINCT f AS file_id FROM n UNION ALL SELECT DISTINCT file_id FROM def) f LEFT JOIN
    (SELECT file_id FROM loc WHERE kind = 'DirectReference' AND substr(name, 1, 1) <> 'V' UNION ALL SELECT f FROM n WHERE form > 2) d ON d.file_id = f.file_id GROUP BY 1""")
def qry11_refresh_all_diagnostics(spark, sf_dir):
    """All files being open: how many diagnostics each is sent, none among them."""
    idx = the_index(spark, sf_dir)
    return idx.refreshed(idx.classified.select("file_id")).select("file_id", F.size("diagnostics").cast("bigint").alias("n"))


@indexed("SELECT count(DISTINCT n.f) + (SELECT count(DISTINCT f) FROM def) AS total_files, (SELECT count(DISTINCT f) FROM def) AS env_files, (SELECT count(*) FROM (SELECT name FROM loc WHERE kind <> 'BindingUsage' AND kind <> 'PropertyAccess' UNION SELECT key FROM def)) AS total_env_vars, (SELECT count(*) FROM n WHERE form = 5) AS exported_env_vars FROM n")
def agg10_workspace_metrics(spark, sf_dir):
    return the_index(spark, sf_dir).metrics()


def _saved(spark, sf_dir) -> str:
    """The folder of the workspace's index. So few buckets that small tables stay few files."""
    path = shared_folder(spark, "index")
    stored.save(the_index(spark, sf_dir), path, buckets=8)
    return path


@indexed("SELECT file_id, name, kind, CAST(sl AS INTEGER) AS sl, CAST(sc AS INTEGER) AS sc FROM loc")
def snk04_stored_index(spark, sf_dir):
    """The locations that a later session reads from the stored index."""
    return stored.load(spark, _saved(spark, sf_dir)).locations.select("file_id", "name", "kind", "sl", "sc")


_FIRST = "(SELECT p_partkey // 50 AS f, arg_min(p_size, p_partkey) AS s FROM part GROUP BY 1)"


@indexed(f"""SELECT f AS file_id, CASE form WHEN 0 THEN 'V' WHEN 1 THEN 'W' WHEN 3 THEN 'Q' WHEN 4 THEN 'R' ELSE 'X' END || k AS name FROM n JOIN {_FIRST} USING (f) WHERE form <> 2 AND s > 15 AND s < 35
    UNION ALL SELECT f, 'Z' || f FROM {_FIRST} WHERE s <= 15 UNION ALL SELECT file_id, key FROM def""")
def str04_refreshed_index(spark, sf_dir):
    """The stored index after code files changed (their first part's size is 15 at most) or went (35 at least)."""
    path = _saved(spark, sf_dir)
    first = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 50").alias("file_id")).agg(F.min_by("p_size", "p_partkey").alias("s"))
    now = workspace_files(spark, sf_dir).join(first, "file_id", "left").where("s is null or s < 35")
    changed = F.coalesce(F.col("s") <= 15, F.lit(False))
    content = F.when(changed, F.concat(F.lit("const z = process.env.Z"), "file_id", F.lit(";"))).otherwise(F.col("content"))
    stored.refresh(spark, path, now.select("file_id", "path", content.alias("content"), F.when(changed, F.lit("2024-02-01").cast("timestamp")).otherwise(F.col("mtime")).alias("mtime")))
    return stored.load(spark, path).env_to_files.select("file_id", "name")
