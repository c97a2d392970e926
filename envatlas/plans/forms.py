"""Queries of the extractor: source files made of the part keys in every form that a language has, against SQL that knows what each form holds.

A file holds the lines of LINES parts. Line k takes form k modulo the number of forms; every third line is a comment, and strings hold decoys. In
a form {k} is the part's key, {V} a variable's name that the form reads, {N} such a name that it does not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envatlas.plans.registry import query, table
from envatlas.sources import extract, languages

LINES = 50
#: By language: lines with the place of a binding's name in [[ ]].
READS = {
    "javascript": ("const [[a{k}]] = process.env.{V};", "var [[a{k}]] = process.env[\"{V}\"];", "use(import.meta.env.{V});", "use(import.meta.env['{V}'], 'process.env.{N}');", "const x{k} = 1, [[a{k}]] = process.env.{V};", "const t{k} = `${process.env.{V}} process.env.{N}`;", "if (/process.env.{N}/.test(s)) { use(process.env.{V} || 1); }"),
    "typescript": ("let [[a{k}]] = process.env['{V}']!;", "const [[a{k}]]: string = process.env.{V} as string;", "const [[a{k}]]: string | undefined = process.env.{V};", "use(import.meta.env.{V}, \"process.env.{N}\");", "let [[a{k}]] = process.env.{V}!;"),
    "typescriptreact": ("const [[a{k}]] = process.env.{V};", "const el{k} = <p>{process.env.{V}}</p>;", "let [[a{k}]] = process.env['{V}'];", "use(import.meta.env.{V});"),
    "python": ("[[a{k}]] = os.environ.get('{V}')", "[[a{k}]] = os.environ['{V}']", "[[a{k}]]: str = os.getenv('{V}', 'x')", "[[a{k}]] = os.environ.pop('{V}')", "[[a{k}]] = os.environ.setdefault('{V}', 'x')", "[[a{k}]] = dotenv.get_key('.env', '{V}')", "use(dotenv_values('.env')['{V}'])", "[[a{k}]] = config('{V}')", "[[a{k}]] = decouple.config('{V}')", "if ([[a{k}]] := os.getenv('{V}')): pass", "def f{k}(db=os.getenv('{V}')): pass", "c{k} = {'db': os.environ['{V}']}", "use(\"os.environ['{N}']\", o.getenv('{V}'))", "d{k} = f\"{os.environ['{V}']}\" + '''os.getenv('{N}')'''"),
    "rust": ('let [[a{k}]] = std::env::var("{V}").unwrap();', 'let [[a{k}]] = env::var("{V}")?;', 'let [[a{k}]]: Option<_> = env::var_os("{V}");', 'const [[A{k}]]: &str = env!("{V}");', 'static [[A{k}]]: &str = option_env!("{V}");', 'let [[a{k}]] = dotenvy::var("{V}").ok();', 'let [[a{k}]] = dotenv::var("{V}");', 'if let Ok([[a{k}]]) = std::env::var("{V}") { }', 'match env::var("{V}") { Ok([[a{k}]]) => 1, _ => 2 };', "use(r#\"env::var(\"{N}\")\"#);"),
    "go": ('[[a{k}]] := os.Getenv("{V}")', 'var [[a{k}]] = os.Getenv("{V}")', 'var [[a{k}]] string = os.Getenv("{V}")', '[[a{k}]], ok := os.LookupEnv("{V}")', 'if [[a{k}]], ok := os.LookupEnv("{V}"); ok { }', 'if [[a{k}]] := os.Getenv("{V}"); a != "" { }', 'c{k} := Config{[[DB{k}]]: os.Getenv("{V}")}', '[[a{k}]] := viper.GetString("{V}")', 'use(viper.GetBool("{V}"), other.Getenv("{N}"))', 'os.Setenv("{V}", `os.Getenv("{N}")`)', 'os.Unsetenv("{V}")'),
    "lua": ('local [[a{k}]] = os.getenv("{V}")', "[[a{k}]] = os.getenv('{V}')", 'use(os.getenv("{V}"), [[x]])', 'use([=[os.getenv("{N}")]=])'),
    "php": ("$a = 1; [[$a{k}]] = $_ENV['{V}'];", '[[$a{k}]] = $_SERVER["{V}"];', "[[$a{k}]] = getenv('{V}');", "[[$a{k}]] = env('{V}', 1);", "use(config('{V}'));", "use(Env::get('{V}'), \"getenv('{N}')\");", "use(Dotenv::get('{V}'));"),
    "ruby": ("[[a{k}]] = ENV.fetch('{V}')", "[[a{k}]] = ENV['{V}']", "[[a{k}]] = ENV['{V}'] || 'x'", "[[a{k}]] = ENV.fetch('{V}', 1)", "use(1) if ENV.key?('{V}')", "use ENV.values_at('{V}')", "puts \"#{ENV['{V}']} ENV['{N}']\"", "use ENV.include?('{V}')"),
    "bash": ('[[a{k}]]="${{V}:-x}"', "[[a{k}]]=${V}", "export [[a{k}]]=${{V}}", "echo \"y ${{V}}\" '${N}'", "local [[a{k}]]=${{V}:?no}"),
    "c": ('char *[[a{k}]] = getenv("{V}");', 'const char* [[a{k}]] = secure_getenv("{V}");', 'use(getenv("{V}"), "getenv(\\"{N}\\")");'),
    "cpp": ('auto [[a{k}]] = std::getenv("{V}");', 'const char* [[a{k}]] = getenv("{V}");', 'use(std::getenv("{V}"));', 'char* [[a{k}]] = std::getenv("{V}");'),
    "java": ('String [[a{k}]] = System.getenv("{V}");', 'var [[a{k}]] = System.getenv("{V}");', 'private static final String [[A{k}]] = System.getenv("{V}");', 'use(System.getProperty("{V}"));'),
    "kotlin": ('val [[a{k}]] = System.getenv("{V}")', 'var [[a{k}]]: String? = System.getenv("{V}") ?: "x"', 'use("${System.getenv("{V}")} System.getenv({N})")'),
    "csharp": ('var [[a{k}]] = Environment.GetEnvironmentVariable("{V}");', 'string [[a{k}]] = System.Environment.GetEnvironmentVariable("{V}");', 'private readonly string [[a{k}]] = Environment.GetEnvironmentVariable("{V}");', 'use(Environment.GetEnvironmentVariable("{V}"), @"GetEnvironmentVariable({N})");'),
    "elixir": ('[[a{k}]] = System.get_env("{V}")', '[[a{k}]] = System.fetch_env!("{V}")', 'use(System.fetch_env("{V}"))', 'puts("#{System.get_env("{V}")} {N}")'),
    "zig": ('const [[a{k}]] = std.posix.getenv("{V}");', 'var [[a{k}]] = std.os.getenv("{V}") orelse "";', 'use(std.posix.getenv("{V}"));'),
}
READS["lua"] = (*READS["lua"][:2], 'use(os.getenv("{V}"))', READS["lua"][3])
_TOKEN = re.compile(r"\{k\}|\{V\}|\{N\}|\[\[|\]\]")


def _pieces(form: str) -> list[str]:
    out, at = [], 0
    for m in _TOKEN.finditer(form):
        out += [form[at : m.start()], m[0]]
        at = m.end()
    return [x for x in (*out, form[at:]) if x]


def _text(form: str, k: Column) -> Column:
    made = {"{k}": k, "{V}": F.concat(F.lit("VAR_"), k), "{N}": F.concat(F.lit("NOT_"), k)}
    return F.concat(F.lit(""), *[made.get(p, F.lit(p)) for p in _pieces(form) if p not in ("[[", "]]")])


def _sql_text(pieces: list[str]) -> str:
    made = {"{k}": "k", "{V}": "'VAR_' || k", "{N}": "'NOT_' || k"}
    return " || ".join(["''", *[made.get(p, "'" + p.replace("'", "''") + "'") for p in pieces if p not in ("[[", "]]")]])


def made_files(spark: SparkSession, sf_dir: str, forms: tuple[str, ...], comment: str) -> DataFrame:
    """(file_id, content): all parts, by the rules above."""
    k = F.col("p_partkey").cast("string")
    line = None
    for i, form in enumerate(forms):
        hit, body = F.col("p_partkey") % len(forms) == i, _text(form, k)
        line = F.when(hit, body) if line is None else line.when(hit, body)
    line = F.concat(F.when(F.col("p_partkey") % 3 == 0, comment + " ").otherwise(""), line)
    parts = table(spark, sf_dir, "part").select(F.expr(f"p_partkey div {LINES}").alias("file_id"), F.struct("p_partkey", line.alias("line")).alias("x"))
    return parts.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("content"))


_LINES = f"lines AS (SELECT p_partkey AS n, CAST(p_partkey AS VARCHAR) AS k, p_partkey // {LINES} AS file_id, CAST(row_number() OVER (PARTITION BY p_partkey // {LINES} ORDER BY p_partkey) - 1 AS INTEGER) AS nsl FROM part)"


def _cases(forms: tuple[str, ...], value) -> str:
    return f"CASE n % {len(forms)} " + " ".join(f"WHEN {i} THEN {value(f)}" for i, f in enumerate(forms)) + " END"


def _reads_sql(lang: str, kind: str) -> str:
    forms = READS[lang]

    def before(form: str, mark: str) -> str:
        p = _pieces(form)
        return f"length({_sql_text(p[: p.index(mark)])})" if mark in p else "NULL"

    def bound(form: str) -> str:
        p = _pieces(form)
        return _sql_text(p[p.index("[[") + 1 : p.index("]]")]) if "[[" in p and "{V}" in p else "NULL"

    if kind == "reference":
        name, key, at = _cases(forms, lambda f: "'VAR_' || k" if "{V}" in f else "NULL"), "NULL::VARCHAR", _cases(forms, lambda f: before(f, "{V}"))
    else:
        name, key, at = _cases(forms, bound), "'VAR_' || k", _cases(forms, lambda f: before(f, "[["))
    return f"WITH {_LINES} SELECT file_id, name, key, nsl, CAST(nsc AS INTEGER) AS nsc FROM (SELECT file_id, nsl, {name} AS name, {key} AS key, {at} AS nsc, n FROM lines) WHERE n % 3 <> 0 AND name IS NOT NULL"


def _reads(lang: str, kind: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = made_files(spark, sf_dir, READS[lang], languages.BY_NAME[lang].line_comments[0])
        return extract.extract(files.withColumn("lang", F.lit(lang))).where(F.col("kind") == kind).select("file_id", "name", "key", "nsl", "nsc")

    query(_reads_sql(lang, kind), f"ext{'03_refs' if kind == 'reference' else '05_bindings'}_{lang}")(f)


for _lang in READS:
    _reads(_lang, "reference")
    _reads(_lang, "binding")


#: By kind of fact and language: (line, facts as name, key, source, module, alias; {k} as above, None where a column is null).
HOLDS = {
    "import": {
        "javascript": (("import d{k} from './m{k}';", (("./m{k}", None, None, "./m{k}", "d{k}"),)), ("import * as n{k} from \"m{k}\";", (("m{k}", None, None, "m{k}", "n{k}"),)), ("import { x{k}, y as z{k} } from 'm';", (("x{k}", None, None, "m", "x{k}"), ("y", None, None, "m", "z{k}"))), ("const r{k} = require('m{k}');", (("m{k}", None, None, "m{k}", "r{k}"),)), ("const { p{k}, q: s{k} } = require('m');", (("p{k}", None, None, "m", "p{k}"), ("q", None, None, "m", "s{k}")))),
        "python": (("import os{k}", (("os{k}", None, None, "os{k}", "os{k}"),)), ("import os as o{k}", (("os", None, None, "os", "o{k}"),)), ("from os import environ, path as p{k}", (("environ", None, None, "os", "environ"), ("path", None, None, "os", "p{k}")))),
        "go": (('import e{k} "os"', (("os", None, None, "os", "e{k}"),)), ('import "net/http{k}"', (("net/http{k}", None, None, "net/http{k}", "http{k}"),))),
        "rust": (("use std::env as e{k};", (("std::env", None, None, "std::env", "e{k}"),)), ("use std::env{k};", ())),
        "java": (("import com.a.B{k};", (("com.a.B{k}", None, None, "com.a.B{k}", "B{k}"),)),), "bash": (("source ./s{k}.sh", (("./s{k}.sh", None, None, "./s{k}.sh", "sh"),)),), "c": (("#include \"h{k}.h\"", (("h{k}.h", None, None, "h{k}.h", "h"),)),),
    },
    "assignment": {
        "javascript": (("const b{k} = a{k};", (("b{k}", None, "a{k}", None, None),)), ("c{k} = b{k};", (("c{k}", None, "b{k}", None, None),)), ("const d{k} = f(a);", ())), "typescript": (("const b{k}: T = a{k} as T;", (("b{k}", None, "a{k}", None, None),)), ("let c{k} = a{k}!;", (("c{k}", None, "a{k}", None, None),))),
        "python": (("b{k} = a{k}", (("b{k}", None, "a{k}", None, None),)), ("c{k}: T = a{k}", (("c{k}", None, "a{k}", None, None),)), ("d{k} = 'b = a'", ())), "rust": (("let mut b{k} = a{k};", (("b{k}", None, "a{k}", None, None),)), ("let c{k} = a{k}.clone();", (("c{k}", None, "a{k}", None, None),))), "go": (("b{k} := a{k}", (("b{k}", None, "a{k}", None, None),)), ("var c{k} T = a{k}", (("c{k}", None, "a{k}", None, None),))), "java": (("String b{k} = a{k};", (("b{k}", None, "a{k}", None, None),)),), "php": (("$b{k} = $a{k};", (("$b{k}", None, "$a{k}", None, None),)),),
    },
    "destructure": {
        "javascript": (("const { A{k} } = env;", (("A{k}", "A{k}", "env", None, None),)), ("const { B: b{k}, C: c{k} = 'x,y' } = env;", (("b{k}", "B", "env", None, None), ("c{k}", "C", "env", None, None))), ("const { D{k} = f(1, 2) } = env;", (("D{k}", "D{k}", "env", None, None),))), "typescript": (("const { A{k} } = env as T;", (("A{k}", "A{k}", "env", None, None),)), ("const { A{k} } = env!;", (("A{k}", "A{k}", "env", None, None),))),
        "python": (("a{k} = env['K{k}']", (("a{k}", "K{k}", "env", None, None),)), ("b{k} = env.get('K{k}')", (("b{k}", "K{k}", "env", None, None),)), ("a, b{k} = env['A'], env['B']", ())), "go": (('v{k} := m["K{k}"]', (("v{k}", "K{k}", "m", None, None),)), ('v{k}, ok := m["K{k}"]', (("v{k}", "K{k}", "m", None, None),))), "lua": (("local x{k} = t.k{k}", (("x{k}", "k{k}", "t", None, None),)), ('x{k} = t["k{k}"]', (("x{k}", "k{k}", "t", None, None),))), "ruby": (("a{k} = h[:k{k}]", (("a{k}", "k{k}", "h", None, None),)), ("a{k} = h['k{k}']", (("a{k}", "k{k}", "h", None, None),))), "php": (("$a{k} = $h['k{k}'];", (("$a{k}", "k{k}", "$h", None, None),)),), "rust": (("let v{k} = cfg.db{k};", (("v{k}", "db{k}", "cfg", None, None),)),),
    },
    "reassignment": {"javascript": (("a{k} = 1;", (("a{k}", None, None, None, None),)), ("b{k}++;", (("b{k}", None, None, None, None),)), ("const c{k} = 1;", ()), ("--d{k};", (("d{k}", None, None, None, None),))), "python": (("a{k} = 1", (("a{k}", None, None, None, None),)), ("f(b=1)", ())), "go": (("a{k} = 1", (("a{k}", None, None, None, None),)), ("b{k} := 1", ())), "bash": (("A{k}=1", (("A{k}", None, None, None, None),)),), "rust": (("a{k} = 1;", (("a{k}", None, None, None, None),)), ("let b{k} = 1;", ()))},
    "export": {
        "javascript": (("export const a{k} = x;", (("a{k}", "x", "a{k}", None, None),)), ("export { b{k}, c as d{k} };", (("b{k}", None, "b{k}", None, None), ("d{k}", None, "c", None, None))), ("export { e{k} } from './m';", (("e{k}", None, "e{k}", "./m", None),)), ("export function f{k}() {}", (("f{k}", None, "f{k}", None, None),)), ("export default g{k};", (("default", "g{k}", "g{k}", None, None),)), ("module.exports.h{k} = y;", (("h{k}", "y", "h{k}", None, None),)), ("export class C{k} {}", (("C{k}", None, "C{k}", None, None),)), ("export * as ns{k} from './o';", (("ns{k}", None, "ns{k}", "./o", None),))),
        "python": (("A{k} = x", (("A{k}", "x", "A{k}", None, None),)), ("def f{k}(): pass", (("f{k}", None, "f{k}", None, None),)), ("class C{k}: pass", (("C{k}", None, "C{k}", None, None),))), "rust": (("pub const A{k}: T = x;", (("A{k}", "x", "A{k}", None, None),)), ("pub fn f{k}() {}", (("f{k}", None, "f{k}", None, None),)), ("fn g{k}() {}", ())), "go": (("func F{k}() {}", (("F{k}", None, "F{k}", None, None),)), ("func f{k}() {}", ()), ("type T{k} struct{}", (("T{k}", None, "T{k}", None, None),))), "java": (("public class C{k} {}", (("C{k}", None, "C{k}", None, None),)),), "kotlin": (("fun f{k}() {}", (("f{k}", None, "f{k}", None, None),)),), "elixir": (("def f{k}(x), do: x", (("f{k}", None, "f{k}", None, None),)),), "zig": (("pub fn f{k}() void {}", (("f{k}", None, "f{k}", None, None),)),),
    },
    "property": {"javascript": (("use(env.P{k});", (("P{k}", None, "env", None, None),)), ('use(env["Q{k}"]);', (("Q{k}", None, "env", None, None),)), ("use('env.R{k}');", ())), "python": (("use(env.P{k})", ()),)},
    "identifier": {"javascript": (("use(a{k}, b.c{k}, 'd{k}');", (("use", None, None, None, None), ("a{k}", None, None, None, None), ("b", None, None, None, None))),), "php": (("$x = [$a{k}, '$b'];", (("$x", None, None, None, None), ("$a{k}", None, None, None, None))),), "python": (("f{k}(g) if h else f'{i{k}}'", tuple((x, None, None, None, None) for x in ("f{k}", "g", "h", "i{k}"))),)},
    "error": {"javascript": (("f{k}();", ()), ("g{k} ];", (("Unexpected: ];", None, None, None, None),)), ("h{k} = 'x;", (("Unexpected: 'x;", None, None, None, None),)))},
}
_COLUMNS = ("name", "key", "source", "module", "alias")
QUERY_OF = {"import": "ext06_imports", "assignment": "ext10_assignments", "destructure": "ext11_destructures", "reassignment": "ext08_reassignments", "export": "ext12_exports", "property": "ext14_members", "identifier": "ext09_identifiers", "error": "ext13_syntax_errors"}


def _holds(kind: str) -> None:
    by_lang = HOLDS[kind]

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        for lang, forms in by_lang.items():
            files = made_files(spark, sf_dir, tuple(x for x, _ in forms), languages.BY_NAME[lang].line_comments[0]).withColumn("lang", F.lit(lang))
            out = files if out is None else out.unionByName(files)
        facts = extract.extract(out.withColumn("file_id", F.hash("lang").cast("bigint") * 1_000_000 + F.col("file_id"))).where(F.col("kind") == kind)
        return facts.select(F.expr("pmod(file_id, 1000000)").alias("file_id"), *_COLUMNS, "nsl")

    parts = []
    for forms in by_lang.values():
        for i, (_, facts) in enumerate(forms):
            parts += ["SELECT file_id, " + ", ".join(("NULL::VARCHAR" if v is None else _sql_text(_pieces(v))) + f" AS {c}" for c, v in zip(_COLUMNS, fact, strict=True)) + f", nsl FROM lines WHERE n % 3 <> 0 AND n % {len(forms)} = {i}" for fact in facts]
    query(f"WITH {_LINES} " + " UNION ALL ".join(parts), QUERY_OF[kind])(f)


for _kind in HOLDS:
    _holds(_kind)
