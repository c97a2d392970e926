"""Queries of what the extractor takes from source text beyond one pattern a line, of languages, of specifiers, and of how env files override each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envatlas.functions import text
from envatlas.operators import filters, graph
from envatlas.plans.index_queries import _filled
from envatlas.plans.registry import query, table
from envatlas.plans.workspace import Index
from envatlas.sources import extract


def _files(spark, sf_dir: str, forms: tuple[tuple[str, str], ...]) -> DataFrame:
    """file_id, lang, content: one file a part, of the (language, content) that its key's remainder picks; {k} is the key."""
    k = F.col("p_partkey")
    at = (k % len(forms) + 1).cast("int")
    said = F.element_at(F.array(*[_filled(x, k.cast("string")) for _, x in forms]), at)
    return table(spark, sf_dir, "part").select(k.cast("bigint").alias("file_id"), F.element_at(F.array(*[F.lit(x) for x, _ in forms]), at).alias("lang"), said.alias("content"))


def _facts(spark, sf_dir: str, forms: tuple[tuple[str, str], ...], kind: str) -> DataFrame:
    return extract.extract(_files(spark, sf_dir, forms)).where(F.col("kind") == kind)


_COMMENTED = (
    ("javascript", "// process.env.C{k}\nx = process.env.V{k}; /* process.env.D{k}\n process.env.E{k} */ y = '// ' + process.env.W{k}"),
    ("python", "# os.environ['C{k}']\nx = os.environ['V{k}']  # os.environ['D{k}']\ny = '# ' + os.environ['W{k}']"),
    ("ruby", "=begin\nENV['C{k}']\n=end\nx = ENV['V{k}'] # ENV['D{k}']\ny = '# ' + ENV['W{k}']"),
    ("go", "/* os.Getenv(\"C{k}\")\n*/ x := os.Getenv(\"V{k}\") // os.Getenv(\"D{k}\")\ny := `// ` + os.Getenv(\"W{k}\")"),
)


@query("SELECT p_partkey AS file_id, x.v || p_partkey AS name, CASE WHEN x.v = 'V' THEN CASE p_partkey % 4 WHEN 2 THEN 3 ELSE 1 END ELSE CASE p_partkey % 4 WHEN 2 THEN 4 ELSE 2 END END AS line FROM part, (VALUES ('V'), ('W')) x(v)")
def ext02_skip_comments(spark, sf_dir):
    return _facts(spark, sf_dir, _COMMENTED, "reference").select("file_id", "name", F.col("nsl").alias("line"))


_DOCUMENTS = (
    ("bash", "cat <<EOF > f\nit's $A{k} (and [\n# $B{k}\nEOF\necho '$N{k}' $C{k}"),
    ("bash", "cat <<'EOF'\n$N{k} \"\nEOF\ncat <<-X <<Y\n$A{k}\n\tX\n$B{k}\nY\necho $C{k}"),
    ("php", "$a = <<<EOT\ngetenv('N{k}') {$x[getenv('A{k}')]} \"\n  EOT;\n$b = getenv('B{k}'); $c = <<<'N'\n{$_ENV['N{k}']}\nN;\n$d = $_ENV['C{k}'];"),
    ("ruby", "f(<<~EOS, ENV['A{k}'])\n  ENV['N{k}'] #{ENV['B{k}']} it's\n  EOS\ng(<<-'Q')\n#{ENV['N{k}']}\n  Q\nENV['C{k}']"),
)


@query("SELECT p_partkey AS file_id, x.v || p_partkey AS name FROM part, (VALUES ('A'), ('B'), ('C')) x(v)")
def ext03_refs_in_here_documents(spark, sf_dir):
    return _facts(spark, sf_dir, _DOCUMENTS, "reference").select("file_id", "name")


_SUITES = (
    ("python", "if x: a = os.environ['A{k}']; b = os.getenv('B{k}')"),
    ("python", "try: a = os.environ['A{k}']\nexcept KeyError: b: str = os.environ['B{k}']"),
    ("python", "for i in d[1: 2]: a = os.environ.get('A{k}')\nelse: b = os.environ['B{k}']\nif s == \"x: q = os.environ['N{k}']\": pass"),
)


@query("SELECT p_partkey AS file_id, lower(x.v) AS name, x.v || p_partkey AS key, CASE WHEN x.v = 'A' OR p_partkey % 3 = 0 THEN 0 ELSE 1 END AS line FROM part, (VALUES ('A'), ('B')) x(v)")
def ext05_bindings_in_suites(spark, sf_dir):
    return _facts(spark, sf_dir, _SUITES, "binding").select("file_id", "name", "key", F.col("nsl").alias("line"))


_REASSIGNED = (
    ("javascript", "let a{k} = process.env.V{k};\na{k} = 1; a{k} += 2; b{k}++; if (c) { b{k} = 3 }"),
    ("python", "a{k} = os.environ['V{k}']\nif x: b{k} = 1\na{k} = 2"),
    ("go", "a{k} := os.Getenv(\"V{k}\")\na{k} = \"x\"\nb{k} = a{k}"),
)


@query("SELECT p_partkey AS file_id, x.v || p_partkey AS name FROM part, (VALUES ('a'), ('b')) x(v)")
def ext07_reassigned_names(spark, sf_dir):
    names = _facts(spark, sf_dir, _REASSIGNED, "reassignment").select("file_id", "name").distinct()
    return names.where(F.col("name") == F.concat(F.substring("name", 1, 1), F.col("file_id")))


_PLACES = (("javascript", "  x = cfg{k}.PORT{k};"), ("typescript", "  x = cfg{k}.PORT{k};"), ("python", "  x = cfg{k}.PORT{k}  "), ("go", "  x = cfg{k}.PORT{k}  "))


@query("SELECT p_partkey AS probe_id, 'cfg' || p_partkey AS object, 'PORT' || p_partkey AS property FROM part")
def ext15_property_at_offset(spark, sf_dir):
    files = _files(spark, sf_dir, _PLACES)
    probes = files.select("file_id", F.col("file_id").alias("probe_id"), F.lit(0).alias("line"), (F.length(F.col("file_id").cast("string")) + 11).alias("character"))
    return extract.by_cursor(probes, files).select("probe_id", "object", "property")


_VALUES_OF = (("javascript", "process.env"), ("javascript", "process.env.K{k}"), ("javascript", "config.K{k}"), ("typescript", "import.meta.env"), ("python", "os.environ['K{k}']"), ("python", "os.environ"), ("ruby", "ENV"), ("ruby", "ENV['K{k}']"), ("php", "$_ENV"), ("php", "getenv('K{k}')"), ("rust", "std::env::var(\"K{k}\")"), ("go", "k{k}"))
_SOURCES = ("Object", "Variable", None, "Object", "Variable", "Object", "Object", "Variable", "Object", "Variable", "Variable", None)


@query(f"SELECT p_partkey AS file_id, CASE p_partkey % {len(_SOURCES)} {' '.join(f'WHEN {i} THEN {chr(39) + s + chr(39)}' for i, s in enumerate(_SOURCES) if s)} END AS source FROM part")
def ext17_env_sources(spark, sf_dir):
    return extract.with_env_source(_files(spark, sf_dir, _VALUES_OF), "content").select("file_id", "source")


_SPECIFIERS = ("./m{k}", "../lib/m{k}", "pkg{k}", "@scope/p{k}", "/abs/m{k}", ".", "..", "pkg{k}/./x")


@query("SELECT p_partkey AS file_id, p_partkey % 8 IN (0, 1) AS relative, p_partkey % 8 NOT IN (0, 1, 4) AS package FROM part")
def flt07_specifiers(spark, sf_dir):
    said = _files(spark, sf_dir, tuple(("javascript", x) for x in _SPECIFIERS))
    return said.select("file_id", text.is_relative(F.col("content")).alias("relative"), filters.is_package(F.col("content")).alias("package"))


_STATEMENTS = (
    ("python", "class A{k}:\n  def f(self):\n    if a:\n      b\n    elif c:\n      d\n    else:\n      e"),
    ("python", "def f{k}():\n  for i in j:\n    try:\n      k\n    except X:\n      l\n    finally:\n      m\n  else:\n    n"),
    ("python", "with f{k}() as a:\n  while b:\n    match c:\n      case 1:\n        d\n    if e: f"),
)
_NESTED = ((("Class", 1, 7), ("Function", 2, 6), ("Conditional", 3, 5)), (("Function", 1, 9), ("Loop", 2, 8), ("Conditional", 3, 5)), (("Block", 1, 5), ("Loop", 2, 4), ("Conditional", 3, 0)))


@query("SELECT p_partkey AS file_id, x.kind, x.own, x.parent, x.lines FROM part JOIN (VALUES " + ", ".join(f"({r}, '{kind}', {i + 2}, {parent}, {lines})" for r, rows in enumerate(_NESTED) for i, (kind, parent, lines) in enumerate(rows)) + ") x(r, kind, own, parent, lines) ON p_partkey % 3 = x.r")
def scp02_statement_scopes(spark, sf_dir):
    rows = _facts(spark, sf_dir, _STATEMENTS, "scope")
    return rows.select("file_id", F.col("name").alias("kind"), "own", F.col("scope").alias("parent"), (F.col("el") - F.col("sl")).alias("lines"))


@query("SELECT p_partkey AS file_id, x.kind, x.n FROM part JOIN (VALUES (0, 'Class', 1), (0, 'Function', 1), (0, 'Conditional', 1), (1, 'Function', 1), (1, 'Loop', 1), (1, 'Conditional', 1), (2, 'Block', 1), (2, 'Loop', 1), (2, 'Conditional', 1)) x(r, kind, n) ON p_partkey % 3 = x.r")
def scp04_scope_kinds(spark, sf_dir):
    scopes = graph.scopes(extract.extract(_files(spark, sf_dir, _STATEMENTS)))
    return scopes.groupBy("file_id", "kind").agg(F.count("*").cast("int").alias("n"))


_PATHS_OF = ("a{k}.js", "a{k}.mjs", "a{k}.tsx", "a{k}.py", "dir.py/a{k}.rs", "a{k}.JS", "a{k}", "a{k}.test.ts", "x/.a{k}.go", "a{k}.rb", "a{k}.sh", "a{k}.kt")
_LANGUAGES = ("javascript", "javascript", "typescriptreact", "python", "rust", None, None, "typescript", "go", "ruby", "bash", "kotlin")


@query(f"SELECT p_partkey AS file_id, CASE p_partkey % {len(_LANGUAGES)} {' '.join(f'WHEN {i} THEN {chr(39) + s + chr(39)}' for i, s in enumerate(_LANGUAGES) if s)} END AS lang FROM part")
def src07_languages(spark, sf_dir):
    paths = _files(spark, sf_dir, tuple(("", x) for x in _PATHS_OF)).select("file_id", F.col("content").alias("path"))
    return extract.with_language(paths).select("file_id", "lang")


def _env_workspace(spark, sf_dir: str, rows: DataFrame) -> DataFrame:
    """file_id, path, content, mtime of env files from rows (path, n, line)."""
    found = rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("content"))
    return found.select(F.xxhash64("path").alias("file_id"), "path", "content", F.lit("2024-01-01").cast("timestamp").alias("mtime"))


@query("SELECT 'K' || p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 'local' WHEN p_partkey % 3 = 1 THEN 'plain' ELSE 'test' END || p_partkey AS value FROM part")
def val04_override_order(spark, sf_dir):
    """Each key stands in up to three files of a folder; the file of the later glob wins."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(k.alias("n"), F.expr("p_partkey div 50").alias("f"))
    names = F.array(*[F.struct(F.lit(file).alias("file"), F.lit(word).alias("word"), F.lit(rest).alias("rest")) for file, word, rest in ((".env", "plain", -1), (".env.local", "local", 0), (".env.test", "test", 2))])
    rows = parts.withColumn("x", F.explode(names)).where("x.rest = -1 or n % 3 = x.rest").select(F.concat(F.lit("e"), "f", F.lit("/"), "x.file").alias("path"), "n", F.concat(F.lit("K"), "n", F.lit("="), "x.word", "n").alias("line"))
    return Index(_env_workspace(spark, sf_dir, rows), [".env", ".env.test", ".env.local"]).values.select("key", "value")


@query("SELECT x.on_ AS interpolated, y.v || p_partkey AS key, CASE WHEN y.v = 'B' THEN 'b' || p_partkey WHEN x.on_ THEN 'a-b' || p_partkey ELSE 'a-${B' || p_partkey || '}' END AS value FROM part, (VALUES (true), (false)) x(on_), (VALUES ('A'), ('B')) y(v)")
def val07_interpolation_toggle(spark, sf_dir):
    k = F.col("p_partkey")
    line = F.concat(F.lit("A"), k, F.lit("=a-${B"), k, F.lit("}\nB"), k, F.lit("=b"), k)
    files = _env_workspace(spark, sf_dir, table(spark, sf_dir, "part").select(F.concat(F.lit("e"), F.expr("p_partkey div 50"), F.lit("/.env")).alias("path"), k.alias("n"), line.alias("line")))
    both = [Index(files, [".env"], interpolate=x).values.select(F.lit(x).alias("interpolated"), "key", "value") for x in (True, False)]
    return both[0].unionByName(both[1])
