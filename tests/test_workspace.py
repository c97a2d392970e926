"""A small workspace from files to answers: extraction, graph, exports, values, endpoints, commands, config, providers and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from envatlas.operators import endpoints, filters, graph, modules, positions, scopes, workspace
from envatlas.plans import commands
from envatlas.plans.workspace import Index
from envatlas.sources import config, extract, files, providers
from envatlas.streaming import index

APP = """import { url as link, env as shared } from './config';
import def from './config';
const env = process.env;
const port = process.env.PORT;
const again = port;
const { API_KEY: key, DEBUG } = env;
function f(port) {
  return again + key + env.HOST;
}
let out = shared.TOKEN + link + process.env.MISSING;
again = 1;
use(again);
"""
CONFIG = """export const url = process.env.DB_URL;
export const env = process.env;
const x = process.env.DEFAULTED;
export default x;
export * from './deep';
"""
DEEP = "const { A: a } = process.env;\nexport { a as deep };\nexport { url as far } from './config';\n"
ENV = 'DB_URL=one\nPORT=8080\nexport API_KEY="k ${PORT}"\nMULTI="a\nb"\nEMPTY=\nBAD LINE\n'
LOCAL = "PORT=9090\n# PORT=1\nDEBUGHAT=1\n"
FILES = [(1, "src/app.js", APP), (2, "src/config.ts", CONFIG), (3, "src/deep.js", DEEP), (4, ".env", ENV), (5, ".env.local", LOCAL), (6, "notes.txt", "process.env.NOT")]


@pytest.fixture(scope="module")
def table(spark):
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, p, c, at) for i, p, c in FILES], "file_id bigint, path string, content string, mtime timestamp")


@pytest.fixture(scope="module")
def idx(table):
    return Index(table, [".env", ".env.local"])


def place(text, needle, nth=0, off=0):
    at = -1
    for _ in range(nth + 1):
        at = text.index(needle, at + 1)
    before = text[: at + off]
    return before.count("\n"), len(before) - before.rfind("\n") - 1


def probes(spark, *at):
    return spark.createDataFrame([(f, i, *p) for i, (f, p) in enumerate(at)], "file_id bigint, probe_id bigint, line int, character int")


def test_graph(idx):
    s = {(r.file_id, r.name): (r.resolved_kind, r.resolved_name, r.is_valid) for r in idx.graph.symbols.collect()}
    assert s[1, "env"] == ("Object", "process.env", True) and s[1, "port"] == ("Variable", "PORT", True)
    assert s[1, "again"] == ("Variable", "PORT", False) and s[1, "key"] == ("Variable", "API_KEY", True) and s[1, "DEBUG"] == ("Variable", "DEBUG", True)
    uses = {(r.identifier, r.property, r.variable) for r in idx.graph.usages.where("file_id = 1").collect()}
    assert {("again", None, "PORT"), ("key", None, "API_KEY"), ("env", "HOST", "HOST")} <= uses
    kinds = {(r.name, r.kind, r.sl) for r in idx.locations.where("file_id = 1").collect()}
    assert ("API_KEY", "BindingDeclaration", 5) in kinds and ("HOST", "PropertyAccess", 7) in kinds and ("PORT", "BindingUsage", 7) in kinds and ("PORT", "DirectReference", 3) in kinds
    assert {r.name for r in idx.graph.all_env_vars().where("file_id = 1").collect()} == {"PORT", "API_KEY", "DEBUG", "MISSING"}
    assert {r.name for r in idx.graph.all_env_vars(True).where("file_id = 1").collect()} == {"PORT", "API_KEY", "DEBUG", "MISSING", "HOST"}
    stats = {r.file_id: r for r in idx.graph.stats().collect()}
    assert stats[1].refs == 2 and stats[1].scopes == 2 and stats[1].symbols == 5
    assert {r.file_id: r.lines for r in idx.graph.document_size().collect()}[1] == 12


def test_exports(spark, idx):
    out = {(r.file_id, r.exported_name): (r.res_kind, r.res_name) for r in idx.exports.collect()}
    assert out == {(2, "url"): ("EnvVar", "DB_URL"), (2, "env"): ("EnvObject", "process.env"), (2, "default"): ("EnvVar", "DEFAULTED"), (3, "deep"): ("EnvVar", "A"), (3, "far"): ("ReExport", None)}
    far = {(r.file_id, r.exported_name): (r.res_name, r.defining_file) for r in idx.resolved_exports.collect()}
    assert far[3, "far"] == ("DB_URL", 2) and far[2, "deep"] == ("A", 3) and far[2, "far"] == ("DB_URL", 2) if (2, "far") in far else far[2, "deep"] == ("A", 3)
    assert {(r.alias, r.res_kind, r.res_name) for r in idx.imported.where("file_id = 1").collect()} == {("link", "EnvVar", "DB_URL"), ("shared", "EnvObject", "process.env"), ("def", "EnvVar", "DEFAULTED")}
    assert {r.name for r in idx.all_exported_env_vars().collect()} == {"DB_URL", "DEFAULTED", "A"}
    names = graph.namespace_import(idx.resolved_exports, spark.createDataFrame([(1, 2)], "file_id bigint, target_id bigint"))
    assert {r.exported_name for r in names.collect()} >= {"url", "deep"}
    assert [r.file_id for r in filters.is_exports_empty(idx.classified, idx.exports, graph.wildcards(idx.graph)).orderBy("file_id").collect()] == [1, 4, 5, 6]
    assert {r.file_id: r.has_exports for r in graph.has_exports(idx.classified.select("file_id"), idx.exports, graph.wildcards(idx.graph)).collect()}[2]


def test_positions_and_hover(spark, idx):
    p = probes(spark, (1, place(APP, "process.env.PORT", off=13)), (1, place(APP, "again", 1)), (1, place(APP, "API_KEY")), (1, place(APP, "HOST")), (1, place(APP, "link", 1)), (1, place(APP, "TOKEN")), (1, place(APP, "process.env.PORT")), (1, place(APP, "env = ")), (9, (0, 0)))
    got = {r.probe_id: (r.hit, r.variable) for r in positions.resolved_at(p, idx.graph, idx.imported).collect()}
    assert got == {0: ("DirectReference", "PORT"), 1: ("LocalUsage", "PORT"), 2: ("DestructureKey", "API_KEY"), 3: ("LocalUsage", "HOST"), 4: ("CrossModule", "DB_URL"), 5: ("ImportedEnvObjectProperty", "TOKEN"), 6: (None, None), 7: (None, None), 8: (None, None)}
    said = {r.probe_id: r.markdown for r in idx.hover(p).collect()}
    assert said[1] == "**`again`** → **`PORT`**\n\n**Value**: `9090`\n\n**Source**: `.env.local`" and "*Environment Object*" in said[7] and said[2].startswith("**`key`** → **`API_KEY`**\n\n**Value**: `k 9090`") and said[3] is None
    assert idx.hover(p, enabled=False).count() == 0
    where = {r.probe_id: (r.def_file, r.def_sl, r.def_sc, r.def_ec) for r in idx.definition(p).collect()}
    assert where[0] == (4, 1, 0, 4) and where[2] == (4, 2, 7, 14) and where[3][0] is None
    kinds = {r.probe_id: r.binding_kind for r in positions.binding_at(probes(spark, (1, place(APP, "env = ")), (1, place(APP, "again = port")), (1, place(APP, "port"))), idx.graph).collect()}
    assert kinds[0] == "Object" and kinds[1] is None
    assert positions.reference_at(p, idx.graph).where("hit is not null").count() == 1 and positions.usage_at(p, idx.graph).where("hit is not null").count() == 2


def test_completion(spark, table):
    content = "const e = process.env;\nx = process.env.\ny = e.\nz = other.\n"
    one = spark.createDataFrame([(1, "a.js", content, None), (2, ".env", "A=1\nB=\n", None)], table.schema)
    index_ = Index(one, [".env"])
    p = probes(spark, (1, (1, 16)), (1, (2, 6)), (1, (3, 10)), (1, (0, 3)))
    assert {(r.probe_id, r.label) for r in index_.completion(p).collect()} == {(0, "A"), (0, "B"), (1, "A"), (1, "B")}
    assert {r.probe_id for r in index_.completion(p, strict=False).collect()} == {0, 1, 2, 3} and index_.completion(p, enabled=False).count() == 0


def test_references_rename_symbols(spark, idx):
    names = spark.createDataFrame([("PORT", "PORT2"), ("DEBUG", "bad name"), ("API_KEY", "KEY")], "old string, new_text string")
    refs = {(r.name, r.file_id, r.kind) for r in idx.references(names.select(F.col("old").alias("name"))).collect()}
    assert ("PORT", 4, "Definition") in refs and ("PORT", 1, "DirectReference") in refs and not [r for r in refs if r[2] == "BindingUsage"]
    edits = idx.rename(names).collect()
    assert {(r.old, r.file_id, r.sl) for r in edits} == {("PORT", 1, 3), ("PORT", 4, 1), ("API_KEY", 1, 5), ("API_KEY", 4, 2)}
    assert {(r.old, r.file_id, len(r.edits)) for r in endpoints.workspace_edit(idx.rename(names)).collect()} == {("PORT", 1, 1), ("PORT", 4, 1), ("API_KEY", 1, 1), ("API_KEY", 4, 1)}
    rows = idx.symbols("debug").collect()
    assert [(r.name, r.file_id) for r in rows] == [("DEBUG", 1), ("DEBUGHAT", 5)] and rows[0].container == "Environment Variables"
    ready = {(r.probe_id, r.variable, r.sc, r.ec) for r in idx.prepare_rename(probes(spark, (4, (1, 4)), (4, (1, 6)), (1, place(APP, "HOST")))).collect()}
    assert ready == {(0, "PORT", 0, 4), (2, "HOST", *[place(APP, "HOST", off=o)[1] for o in (0, 4)])}


def test_diagnostics_and_hints(spark, idx, table):
    found = {(r.file_id, r.code, r.sl, r.severity) for r in idx.diagnostics().collect()}
    line = place(APP, "MISSING")[0]
    assert (1, "undefined-env-var", line, "WARNING") in found and (4, "EDF999", 6, "ERROR") in found and (1, "undefined-env-var", place(APP, "HOST")[0], "WARNING") in found
    assert not [x for x in found if x[0] == 1 and x[2] == 3]
    assert idx.diagnostics(enabled=False).count() == 0
    broken = Index(spark.createDataFrame([(1, "a.js", "f(process.env.A;\n", None)], table.schema), [".env"])
    assert {(r.code, r.message) for r in broken.diagnostics().collect()} == {("syntax-error", "Missing: )"), ("undefined-env-var", "Environment variable 'A' is not defined.")}
    hints = {(r.name, r.line, r.label) for r in idx.inlay_hints().where("file_id = 1").collect()}
    assert ("PORT", 3, "9090") in hints and ("API_KEY", 5, "k 9090") in hints and not [h for h in hints if h[0] == "HOST"]
    assert idx.inlay_hints(window=(0, 0, 2, 0)).where("file_id = 1").count() == 0 and idx.inlay_hints(enabled=False).count() == 0
    assert {r.label for r in idx.inlay_hints(most_length=2).where("name = 'API_KEY'").collect()} == {"k ..."}


def test_values_and_index(spark, idx):
    got = {r.key: (r.value, r.source_path) for r in idx.values.collect()}
    assert got["PORT"] == ("9090", ".env.local") and got["API_KEY"] == ("k 9090", ".env") and got["MULTI"][0] == "a\nb" and got["EMPTY"][0] == ""
    rows = {r.path: r.env_vars for r in idx.file_index().collect()}
    assert rows["src/config.ts"] == ["DB_URL", "DEFAULTED"] and rows[".env.local"] == ["DEBUGHAT", "PORT"] and rows["notes.txt"] == []
    assert idx.stats().first().env_files == 2
    assert {r.file_id for r in filters.files_for(idx.env_to_files, ["PORT"]).collect()} == {1, 4, 5}
    assert {r.name for r in filters.variables_in(idx.env_to_files, spark.createDataFrame([(3,)], "file_id bigint")).collect()} == {"A"}


def test_contexts(spark):
    packages = spark.createDataFrame([("pkg/a",), ("pkg/a/b",)], "package_root string")
    paths = spark.createDataFrame([("pkg/a/x.js",), ("pkg/a/b/c/y.js",), ("pkg/ab/z.js",), ("w.js",)], "path string")
    spots = workspace.contexts(paths, packages)
    assert {r.path: r.package_root for r in spots.collect()} == {"pkg/a/x.js": "pkg/a", "pkg/a/b/c/y.js": "pkg/a/b", "pkg/ab/z.js": "", "w.js": ""}
    rows = spark.createDataFrame([("File", None, ".env", 0, "A", "root"), ("File", None, "pkg/a/.env", 0, "A", "own ${B}"), ("File", None, ".env", 0, "B", "b"), ("Shell", None, None, 0, "C", "c"), ("Shell", None, None, 0, "A", "shell")], files.VALUES)
    rank = spark.createDataFrame([("File", 0), ("Shell", 1)], "source string, source_rank int")
    by = workspace.values_by_context(rows, spots, rank)
    assert {(r.package_root, r.key): r.value for r in by.collect()} == {("", "A"): "root", ("", "B"): "b", ("", "C"): "c", ("pkg/a", "A"): "own b", ("pkg/a", "B"): "b", ("pkg/a", "C"): "c", ("pkg/a/b", "A"): "root", ("pkg/a/b", "B"): "b", ("pkg/a/b", "C"): "c"}
    assert {r.path: r.value for r in workspace.value_for(spots, by, "A").collect()}["pkg/a/x.js"] == "own b"
    assert workspace.values_for(spots, by).count() == 12
    env = spark.createDataFrame([(".env",), ("pkg/a/.env",), ("pkg/a/b/.env",), ("pkg/c/.env",)], "path string")
    assert {r.path for r in workspace.package_files(env, "pkg/a").collect()} == {".env", "pkg/a/.env", "pkg/a/b/.env"}
    assert {r.path for r in workspace.active(env, ["pkg/c/.env"]).collect()} == {"pkg/c/.env"} and workspace.active(env, None).count() == 4


def test_commands(spark, table, tmp_path):
    s = commands.Session(spark, table, files.shell(spark, {"SHELLED": "1", "PORT": "7"}), config=config.load(options={"workspace": {"env_files": [".env", ".env.local"]}}))
    assert s.precedence == ["Shell", "File"]
    got = {r.name: (r.value, r.source) for r in s.run("listEnvVariables").collect()}
    assert got["PORT"] == ("7", "Shell Environment") and got["DB_URL"] == ("one", ".env")
    assert s.run("source.setPrecedence", "file").first().precedence == ["File"]
    assert {r.source: (r.n, r.enabled) for r in s.run("source.list").collect()} == {"Shell": (0, False), "File": (6, True), "Remote": (0, False)}
    assert s.run("variable.get", "PORT").first().value == "9090" and s.run("variable.get", "NONE").count() == 0
    assert [r.file for r in s.run("file.list").collect()] == [".env", ".env.local"]
    s.run("file.setActive", ".env")
    assert [r.file for r in s.run("file.list").collect()] == [".env"] and s.run("variable.get", "PORT").first().value == "8080" and len(s.run("file.list", None, True).collect()) == 2
    s.run("interpolation.set", False)
    assert s.run("variable.get", "API_KEY").first().value == "k ${PORT}" and not s.run("interpolation.get").first().enabled
    assert "A=" in [r.line for r in s.run("generateEnvExample").collect()] and s.run("workspace.list").first()["name"] == "workspace"
    for bad in (("source.setPrecedence", "disk"), ("workspace.setRoot", "/nowhere"), ("workspace.setRoot",), ("variable.get",), ("nothing",), ("provider.authFields", "x")):
        with pytest.raises(commands.CommandError):
            s.run(*bad)
    s.run("source.setPrecedence")
    assert s.run("listEnvVariables").count() == 0
    with pytest.raises(commands.CommandError):
        s.run("file.list")
    (tmp_path / ".env").write_text("NEW=1")
    (tmp_path / "envatlas.toml").write_text('[resolution]\nprecedence = ["File"]\n')
    assert s.run("workspace.setRoot", str(tmp_path)).first().success
    s.run("file.setActive")
    assert {r.name for r in s.run("listEnvVariables").collect()} == {"NEW"}


def test_config(tmp_path):
    assert config.merged({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"b": None, "c": 3}, "d": [2], "e": {"f": 1}}) == {"a": {"b": 1, "c": 3}, "d": [2], "e": {"f": 1}}
    (tmp_path / "envatlas.toml").write_text("[features]\nhover = false\n[sources.defaults]\nshell = false\nremote = true\n")
    c = config.load(tmp_path, {"features": {"inlay_hints": True}})
    assert not c["features"]["hover"] and c["features"]["inlay_hints"] and c["resolution"]["precedence"] == ["File", "Remote"]
    assert config.shown_kinds(c["inlay_hints"]) == ("DirectReference", "BindingDeclaration", "PropertyAccess")
    (tmp_path / "envatlas.toml").write_text("[features")
    with pytest.raises(ValueError, match="Failed to parse"):
        config.load(tmp_path)


def test_providers(spark, tmp_path):
    for project, name, body in (("p", "dev", '{"A": "1"}'), ("p", "prod", '{"A": "2", "B": 3}'), ("q", "dev", "{}")):
        (tmp_path / project).mkdir(exist_ok=True)
        (tmp_path / project / f"{name}.json").write_text(body)
    r = providers.Registry()
    r.register(providers.FolderProvider(str(tmp_path), "t"))
    s = commands.Session(spark, spark.createDataFrame([], "file_id bigint, path string, content string, mtime timestamp"), providers=r, config=config.load(options={"resolution": {"precedence": ["Remote"]}}))
    assert s.run("provider.list").first().is_authenticated is False and s.run("provider.authFields", "folder").first().env_var == "FOLDER_TOKEN"
    assert not s.run("provider.authenticate", "folder", {"token": "x"}).first().success and s.run("source.remote.authenticate", "folder", {"token": "t"}).first().success
    assert [x.name for x in s.run("provider.scopeLevels", "folder").collect()] == ["project", "environment"]
    assert [x.option for x in s.run("provider.navigate", "folder", "environment", {"project": ["p"]}).collect()] == ["dev", "prod"]
    s.run("provider.select", "folder", {"project": "p", "environment": "prod"})
    assert {x.name: x.value for x in s.run("listEnvVariables").collect()} == {"A": "2", "B": "3"}
    assert s.run("provider.refresh", "folder").first().n == 2
    s.run("provider.shutdown", "folder")
    assert s.run("listEnvVariables").count() == 0


def test_watched(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([("a.js", "change", t), ("a.js", "delete", t + datetime.timedelta(1)), ("b.js", "create", t), (".env", "change", t), ("envatlas.toml", "change", t)], "path string, type string, ts timestamp")
    actions = index.watched_changes(events, lambda p: p.startswith(".env"))
    assert {r.path: r.action for r in actions.collect()} == {"a.js": "remove", "b.js": "index", ".env": "refresh", "envatlas.toml": "reload"}
    assert sorted(r.kind for r in index.notifications(actions).collect()) == ["log"] * 4 + ["refresh-hints"]
    old = spark.createDataFrame([("a.js", 1), ("b.js", 1), ("c.js", 1)], "path string, v int")
    new = spark.createDataFrame([("b.js", 2), ("a.js", 2)], "path string, v int")
    assert {(r.path, r.v) for r in index.after_changes(old, actions, new).collect()} == {("b.js", 2), ("c.js", 1)}
    edges = spark.createDataFrame([(1, 2), (3, 2), (2, 4)], "file_id int, target_id int")
    gone = spark.createDataFrame([(2,)], "file_id int")
    left, dirty = index.removed(edges, gone.limit(0), gone)
    assert left.count() == 0 and {r.file_id for r in dirty.collect()} == {1, 3}
    assert {(r.file_id, r.target_id) for r in index.replaced_edges(edges, gone, spark.createDataFrame([(2, 5)], "file_id int, target_id int")).collect()} == {(1, 2), (3, 2), (2, 5)}
    assert {r.dependent_id for r in index.dependents(edges).where("file_id = 2").collect()} == {1, 3}
    assert {r.file_id for r in index.dirty_after(gone.limit(0), edges, gone, spark.createDataFrame([(1,)], "file_id int")).collect()} == {3}
    assert ("**/.env", "create,change,delete") in files.watched() and ("**/*.rs", "create,delete") in files.watched()
    symbols = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 6, 9)], "file_id int, symbol_id int, start int, end int")
    uses = spark.createDataFrame([(1, 1, 1, 20, 21), (1, 2, 2, 22, 23)], "file_id int, usage_id int, symbol_id int, start int, end int")
    a, b = index.without_ranges(symbols, uses, spark.createDataFrame([(1, 4, 5)], "file_id int, start int, end int"))
    assert [r.symbol_id for r in a.collect()] == [2] and [r.usage_id for r in b.collect()] == [2] and index.is_large_edit(6, 10) and not index.is_large_edit(5, 10)


def test_publish(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("u", t, 1, "process.env.A"), ("v", t, 1, "1"), ("z", t + datetime.timedelta(minutes=5), 1, "")]
    spark.createDataFrame(rows, "uri string, ts timestamp, version bigint, content string").coalesce(1).write.parquet(str(tmp_path / "in"))
    edits = spark.readStream.schema("uri string, ts timestamp, version bigint, content string").parquet(str(tmp_path / "in"))

    def diagnose(docs):
        g = graph.analysed(docs.select(F.xxhash64("uri").alias("file_id"), F.lit("javascript").alias("lang"), "content"))
        found = endpoints.diagnostics(g, spark.createDataFrame([], "key string"))
        return docs.select("uri", F.xxhash64("uri").alias("file_id")).join(found, "file_id").drop("file_id")

    with index.Cancellable(spark, "diagnose") as job:
        q = job.follow(index.publish(edits, str(tmp_path / "out"), diagnose, str(tmp_path / "cp")))
        q.awaitTermination(200)
        assert index.heartbeat(q)["active"] is False
        job.cancel()
    assert {(r.uri, r.n) for r in spark.read.parquet(str(tmp_path / "out/published")).collect()} >= {("u", 1), ("v", 0)}
    assert [r.code for r in spark.read.parquet(str(tmp_path / "out/diagnostics")).where("uri = 'u'").collect()] == ["undefined-env-var"]


def test_scope_operators(spark):
    deep = spark.range(2, 102).select(F.lit(1).alias("file_id"), F.col("id").cast("int").alias("scope_id"), (F.col("id") - 1).cast("int").alias("parent_id"))
    assert scopes.closure(deep).agg(F.max("depth")).first()[0] == 100
    import random

    rng = random.Random(3)
    spans = [(f, i, a, a + rng.choice((1, 7, 300, 1 << 34))) for f in (1, 2) for i, a in enumerate((rng.randrange(1 << 35) for _ in range(60)), 2)]
    s = spark.createDataFrame([(*x, x[3] - x[2]) for x in spans], "file_id int, scope_id int, start bigint, end bigint, size bigint")
    at = [(f, i, rng.choice(spans)[2] + rng.randrange(3)) for i, f in enumerate((1, 2, 3) * 40)]
    got = {r.probe_id: r.scope_id for r in scopes.scope_at(spark.createDataFrame(at, "file_id int, probe_id int, at bigint"), s).collect()}
    assert got == {i: min([(b - a, n) for g, n, a, b in spans if g == f and a <= p < b], default=(0, 1))[1] for f, i, p in at}
    w = spark.createDataFrame([(f, i, a + 1, a + 9) for f, i, a, _ in spans[::3]], "file_id int, window_id int, start bigint, end bigint")
    short = [x for x in spans if x[3] - x[2] < 1000]
    got = {tuple(r) for r in scopes.overlapping(s.where("size < 1000"), w).select("file_id", "scope_id", "window_id").collect()}
    assert got == {(f, n, i) for f, n, a, b in short for g, i, c, _ in spans[::3] if f == g and b > c + 1 and c + 9 > a}


def test_cursor(spark):
    rows = {(r.probe_id): (r.context, r.object, r.property) for r in extract.by_cursor(probes(spark, (1, (0, 8)), (1, (1, 5)), (2, (9, 9))), spark.createDataFrame([(1, "javascript", "x = env.PORT;\nenv. "), (2, "go", "")], "file_id bigint, lang string, content string")).collect()}
    assert rows[0][1:] == ("env", "PORT") and rows[2] == (None, None, None)
    assert extract.is_env_source("javascript", "process.env") == "Object" and extract.is_env_source("python", "os.environ['A']") == "Variable" and extract.is_env_source("go", "x") is None
    kinds = filters.import_kind(F.col("o"), F.col("m"), F.col("a"))
    got = [r[0] for r in spark.createDataFrame([("./m", "./m", "d"), ("x", "./m", "x"), ("x", "./m", "y"), ("./m", "./m", None)], "o string, m string, a string").select(kinds).collect()]
    assert got == ["Default", "Named", "NamedAliased", "SideEffect"]
    assert [modules.MOST_DEPTH] == [10]
