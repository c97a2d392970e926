"""Goldens for the extractor on source that trips token patterns."""

import time

import pytest

from envatlas.sources import extract


def facts(lang, content, kind, use_imports=False):
    return [(f[3], f[4]) if f[4] else f[3] for f in extract.facts(1, lang, content, use_imports) if f[1] == kind]


@pytest.mark.parametrize(
    ("lang", "content", "kind", "names"),
    [
        ("javascript", 'f("process.env.FAKE", `${process.env.T} process.env.N`, /process.env.R/)', "reference", ["T"]),
        ("python", "\"\"\"os.environ['DOC']\"\"\"\nx = f\"{os.environ['Q']} os.getenv('N')\"", "reference", ["Q"]),
        ("bash", "echo '$NOT' \"$YES\"", "reference", ["YES"]),
        ("php", "getenv('A'); # getenv('B')", "reference", ["A"]),
        ("ruby", "ENV.values_at('A', 'B')", "reference", ["A", "B"]),
        ("python", "a, b = os.environ['A'], os.environ['B']", "binding", []),
        ("typescript", "const a: string = process.env.A!, b = process.env['B'] as string;", "binding", [("a", "A"), ("b", "B")]),
        ("kotlin", 'val a: String = System.getenv("A")', "binding", [("a", "A")]),
        ("javascript", "const { A, B: b } = import.meta.env; const c = 1, d = process.env.D;", "binding", [("A", "A"), ("b", "B"), ("d", "D")]),
        ("go", 'import (\n\t"fmt"\n\te "os"\n)', "import", ["fmt", "os"]),
        ("typescript", "for (let i = 0; i < 3; i++) {\n}\nfunction f()\n{\n}\nconst o = { a: 1 };", "scope", ["Loop", "Function"]),
        ("python", "class A:\n  def f(\n    a,\n  ):\n    if a:\n      b", "scope", ["Class", "Function", "Conditional"]),
        ("lua", "function f()\n  for i = 1, 2 do\n    if x then y() end\n  end\nend", "scope", ["Function", "Loop", "Conditional"]),
        ("python", "if a:\n  b\nelif c:\n  d\nelse:\n  e\ntry:\n  f\nexcept X:\n  g\nfinally:\n  h\nfor i in j:\n  k\nelse:\n  l\nwith m: n\nmatch o:\n  case 1:\n    p", "scope", ["Conditional", "Conditional", "Loop", "Block"]),
        ("python", "def f():\n  if a:\n    b\n  else:\n    if c:\n      d\n    else:\n      e\nelse_ = 1", "scope", ["Function", "Conditional", "Conditional"]),
        ("python", "if x: a = os.environ['A']; b = os.getenv('B')\nelse: a = os.environ['C']\nfor i in d[1: 2]: c: str = os.environ['D']\nif s == \"x: q = os.environ['N']\": pass", "binding", [("a", "A"), ("b", "B"), ("a", "C"), ("c", "D")]),
        ("python", "x: int = y\nz = {a: b}\nif x: v = 1", "reassignment", ["x", "z", "v"]),
        ("bash", "cat <<EOF > f\nit's $A (and ${B}\n# $C\nEOF\necho $D", "reference", ["A", "C", "D", "B"]),
        ("bash", "cat <<'EOF'\n$A \"\nEOF\ncat <<-\"X\" <<Y\n$B\n\tX\n$C\nY\necho $D $((1 << 2))", "reference", ["C", "D"]),
        ("bash", "cat <<EOF\n( ' \" [\nEOF\n", "error", []),
        ("php", "$a = <<<EOT\ngetenv('A') {$x[getenv('B')]} \"\n  EOT;\n$b = getenv('C'); $c = <<<'N'\n{$_ENV['D']}\nN;", "reference", ["B", "C"]),
        ("ruby", "f(<<~EOS, ENV['A'])\n  ENV['B'] #{ENV['C']} it's\n  EOS\nx << y\ng(<<-'Q')\n#{ENV['D']}\n  Q\nENV['E']", "reference", ["A", "C", "E"]),
        ("javascript", "f(1;", "error", ["Missing: )"]),
        ("javascript", "f() ];", "error", ["Unexpected: ];"]),
        ("javascript", "x = a / b; y = c / d; // '", "error", []),
    ],
)
def test_plain_source(lang, content, kind, names):
    assert facts(lang, content, kind) == names


def test_imports_admit_their_names():
    content = "from os import environ as e\nx = e['A']\n"
    assert facts("python", content, "reference") == [] and facts("python", content, "reference", True) == ["A"]
    content = 'import (\n  "fmt"\n  o "os"\n)\nx := o.Getenv("A")'
    assert facts("go", content, "reference") == [] and facts("go", content, "reference", True) == ["A"]


def test_long_lines_take_linear_time():
    spent = []
    for n in (4000, 16000):
        text = "var a={b:function(c){return process.env.D}};" * n
        t = time.process_time()
        assert len(extract.facts(1, "javascript", text)) > 5 * n
        spent.append(time.process_time() - t)
    assert spent[1] < 10 * spent[0]


def test_facts_know_their_scopes():
    rows = [(f[1], f[3], *f[-3:]) for f in extract.facts(1, "javascript", "function f() { if (x) { const a = process.env.A; } }") if f[1] in ("scope", "binding")]
    assert rows == [("binding", "a", 3, None, None), ("scope", "Function", 1, 2, [2, 1]), ("scope", "Conditional", 2, 3, [3, 2, 1])]


def test_unclosed_and_strange_text():
    for lang in ("javascript", "python", "ruby", "rust", "bash", "kotlin", "csharp", "elixir", "php"):
        for text in ('"' * 3, "'", "`${", '"#{' * 50, "{" * 200, "\x00é" + "(" * 50, 'f"{' * 40, "/*", "=begin", 'r#"'):
            extract.facts(1, lang, text + "\n x = 1")


def test_failures_are_told_and_passed_over(caplog):
    from envatlas.functions import errors

    assert errors.ok_logged(lambda: 1 // 0, "a division") is None and errors.ok_warn(lambda: 2, "nothing") == 2
    assert "a division failed" in caplog.text
    assert not extract.compiled("(", "nowhere").search("(") and extract.compiled("a", "nowhere").search("a")
