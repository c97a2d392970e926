"""Goldens for operators on handwritten files, and the registered queries against their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from envatlas.functions import text
from envatlas.operators import modules, scopes, symbols, values
from envatlas.plans import forms, index_queries, more_queries, registry, session_queries, source_queries  # noqa: F401
from envatlas.sources import dotenv, extract, files
from envatlas.streaming import index

SF = "/root/testdata/sf0.001"


def facts(lang, content, kind, aliases=None):
    return [(f[3], f[4]) if f[4] else f[3] for f in extract.facts(1, lang, content, aliases) if f[1] == kind]


@pytest.mark.parametrize(
    ("lang", "content", "names"),
    [
        ("javascript", "a(process.env.A, process.env['B']); // process.env.C\n/* process.env.D */ import.meta.env.E", ["A", "B", "E"]),
        ("python", "os.environ['A']; os.getenv('B')  # os.getenv('C')\nconfig('D'); x['E']", ["A", "B", "D"]),
        ("bash", "echo $A ${B:-x} # $C", ["A", "B"]),
        ("go", 'x := os.Getenv("A"); other.Getenv("B")', ["A"]),
        ("rust", 'env::var("A"); option_env!("B"); dotenvy::var("C")', ["A", "B", "C"]),
        ("ruby", "ENV['A'] || ENV.fetch('B', 1)", ["A", "B"]),
        ("php", "$_SERVER['A']; getenv('B'); Env::get('C');", ["A", "B", "C"]),
    ],
)
def test_references(lang, content, names):
    assert sorted(facts(lang, content, "reference")) == names


def test_import_context_admits_aliases():
    content = "from os import environ as e\nx = e['A']\n"
    assert facts("python", content, "reference") == []
    assert facts("python", content, "reference", True) == ["A"]


def test_javascript_facts():
    content = "const env = process.env;\nconst { A, B: b = '1' } = process.env;\nconst { C: c } = env;\nconst d = env;\nfunction f() { if (d) { d = 2; } }\nimport { x as y } from './m';\nexport { d as e };\nexport * from './n';"
    assert facts("javascript", content, "object") == ["env"]
    assert facts("javascript", content, "binding") == [("A", "A"), ("b", "B")]
    assert ("c", "C") in facts("javascript", content, "destructure")
    assert "d" in facts("javascript", content, "assignment")
    assert facts("javascript", content, "scope") == ["Function", "Conditional"]
    assert facts("javascript", content, "import") == ["x"]
    assert facts("javascript", content, "export") == ["e"]
    assert len(facts("javascript", content, "wildcard")) == 1


def test_robust():
    assert extract.facts(1, "javascript", None) == [] and extract.facts(1, "javascript", "") == [] and extract.facts(1, None, "x") == []
    assert extract.facts(1, "javascript", "\x00é" + "{" * 50 + "process.env.A" * 500)


def test_dotenv(spark):
    content = "A=1\n# B=2\nEMPTY=\nQ=\"a\\nb\" # c\nS='x'\nBAD LINE\nK =1\nD==1\nU=\"x\nA=3"
    rows = {r.key: r.value for r in dotenv.keys(spark.createDataFrame([(1, content)], "file_id bigint, content string")).collect()}
    assert rows == {"A": "3", "EMPTY": "", "Q": "a\nb", "S": "x"}
    codes = [r.error_code for r in dotenv.entries(spark.createDataFrame([(1, content), (2, None)], "file_id bigint, content string")).where("error_code is not null").orderBy("ord").collect()]
    assert codes == ["EDF999", "EDF001", "EDF002", "EDF005"]


def test_walk(tmp_path, spark):
    for name, body in {".env": "A=1", "a.js": "process.env.A", "b.txt": "", "skip/c.js": "", ".gitignore": "skip/\n", "d/.env.local": "B=2"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    assert sorted(files.walk(str(tmp_path))) == [".env", "a.js", "d/.env.local"]
    rows = files.workspace(spark, str(tmp_path)).collect()
    assert {(r.path, r.is_env) for r in rows} == {(".env", True), ("a.js", False), ("d/.env.local", True)}


def test_normalised(spark):
    df = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a/../../x",)], "p string")
    assert [r[0] for r in df.select(text.normalised(F.col("p"))).collect()] == ["a/c", None, None]


def test_scopes_nest(spark):
    spans = spark.createDataFrame([(1, "Function", 0, 0, 9, 1), (1, "Block", 1, 0, 5, 0), (1, "Block", 2, 0, 3, 0), (1, "Loop", 6, 0, 7, 0)], "file_id int, kind string, sl int, sc int, el int, ec int")
    assert [(r.scope_id, r.parent_id) for r in scopes.numbered(spans).orderBy("scope_id").collect()] == [(2, 1), (3, 2), (4, 3), (5, 2)]


def test_chain_limit(spark):
    rows = [(1, 1, "EnvVar", "A", None, None)] + [(1, i, "Symbol", None, i - 1, None) for i in range(2, 13)] + [(1, 20, "EnvObject", "process.env", None, None), (1, 21, "Destructured", None, 20, "B"), (1, 22, "Destructured", None, 1, "B")]
    s = spark.createDataFrame(rows, "file_id int, symbol_id int, origin_kind string, origin_name string, origin_target int, origin_key string")
    got = {r.symbol_id: r.resolved_name for r in symbols.resolve(s).collect()}
    assert got[10] == "A" and got[11] is None and got[21] == "B" and got[22] is None and got[20] == "process.env"


def test_module_cycle(spark):
    exports = spark.createDataFrame([(1, "x", "ReExport", None, 2, "x"), (2, "x", "ReExport", None, 1, "x"), (3, "y", "EnvVar", "Y", None, None)], "file_id int, exported_name string, res_kind string, res_name string, target_file int, orig_name string")
    wild = spark.createDataFrame([(4, 0, 1), (4, 1, 3)], "file_id int, ord int, target_file int")
    assert {(r.file_id, r.exported_name, r.defining_file) for r in modules.resolve_exports(exports, wild).collect()} == {(3, "y", 3), (4, "y", 3)}


def test_interpolation_stops(spark):
    v = spark.createDataFrame([("A", "${A}x"), ("B", "${C}"), ("C", None), ("D", "plain")], "key string, value string")
    got = {r.key: r.value for r in values.interpolated(v).collect()}
    assert got["A"].endswith("x") and got["B"] == "" and got["C"] is None and got["D"] == "plain"
    assert {r.key: r.value for r in values.interpolated(v, enabled=False).collect()}["A"] == "${A}x"


def test_stream(spark, tmp_path):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [("u", at, 1, "process.env.A"), ("u", at + datetime.timedelta(milliseconds=100), 2, "process.env.B"), ("u", at + datetime.timedelta(seconds=5), 3, "process.env.C"), ("z", at + datetime.timedelta(minutes=9), 1, "")]
    spark.createDataFrame(rows, "uri string, ts timestamp, version bigint, content string").coalesce(1).write.parquet(str(tmp_path / "in"))
    edits = spark.readStream.schema("uri string, ts timestamp, version bigint, content string").parquet(str(tmp_path / "in"))
    q = index.maintain(edits, str(tmp_path / "out"), lambda b: b.select("uri", "version", "content"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.uri, r.version) for r in out.collect()} >= {("u", 2), ("u", 3)}
    assert {r.content for r in index.current(out.where("uri = 'u'")).collect()} == {"process.env.C"}


#: Of the queries that build the whole index those tested here; all are held against their SQL at a larger size.
WHOLE = ("src02_index_file", "rec04_export_resolutions", "agg07_graph_stats", "jn07_resolve_origins", "jn14_namespace_import", "jn18_env_at_position", "jn20_resolve_at_position", "qry06_prepare_rename", "qry07_rename", "qry08_diagnostics", "qry10_inlay_hints")


@pytest.mark.parametrize("name", [n for n in registry.ORACLES if registry.QUERIES[n].__module__ != index_queries.__name__ or n in WHOLE])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    found = con.execute(registry.ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())
