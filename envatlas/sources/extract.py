"""One pass over source files: references, bindings, assignments, destructures, reassignments, identifiers, imports, exports, property
accesses, scopes and syntax errors.

Every fact is a row (file_id, kind, ord, name, key, source, module, alias, range, name range, key range, scope). Positions are zero based,
ranges half open. `scope` is the innermost scope around the name (1: the file itself), as the scopes of a file are known when its facts are made;
a scope's own row has its parent there, its id in `own`, and its ids up to the file in `path`, so that nesting needs no join. Null content and unknown languages have no facts. Nothing in a comment or a string is a fact, but for code that a string interpolates.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envatlas.functions import errors
from envatlas.sources.languages import BY_EXTENSION, BY_ID, BY_NAME, END, Language
from envatlas.sources.lexing import Code, scan

_POSITIONS = ", ".join(f"{a}{b} int" for a in ("", "n", "k") for b in ("sl", "sc", "el", "ec"))
SCHEMA = f"file_id bigint, kind string, ord int, name string, key string, source string, module string, alias string, {_POSITIONS}, scope int, own int, path array<int>"
FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]
_END = re.compile(END)
_TAIL = re.compile(r"(?:\s+as\s+[\w$<>\[\]. |&{}:;'\"]+|!)+$")
_PROPERTY = re.compile(r"\s*(?P<key>[A-Za-z_$][\w$]*)(?:\s*:\s*(?P<local>[A-Za-z_$][\w$]*))?(?:\s*=[\s\S]*)?\s*$")
_COMMON = "true false null undefined None True False nil this self super new function await if else return for while do in const var class import from export default async static public private yield throw try catch typeof void delete let"
#: Words that are no names, by language, besides the common ones.
_OWN_KEYWORDS = {
    "python": "def pass lambda elif except with as is not and or match finally raise global nonlocal del assert", "rust": "pub use mut fn match struct impl enum trait mod as move ref where", "go": "func package type struct defer go range chan map", "php": "use fn echo as match foreach elseif list array",
    "ruby": "def end then elsif unless until module begin rescue ensure and or not", "lua": "local end then elseif until repeat and or not", "elixir": "def defp defmodule end fn use alias require when and or not", "kotlin": "fun val when is as object", "bash": "fi then done esac case elif echo local", "zig": "pub fn orelse comptime struct switch",
}
_KEYWORDS_OF = {x: frozenset(f"{_COMMON} {_OWN_KEYWORDS.get(x, '')}".split()) for x in BY_NAME}
_CLOSERS = frozenset(("end", "until", "fi", "done", "esac"))
_BASH_BLOCKS = r"(?:(?<=\n)|(?<=[;&|])|^)[ \t]*(?:if|case|do)\b|(?:(?<=\n)|(?<=[;&|])|^)[ \t]*(?:fi|esac|done)\b"
_METHOD = re.compile(r"\)\s*(?:(?:->|:)\s*[^{=;]+|throws\s+[\w., ]+|const|override|noexcept|where\s[^{]*)?\s*$")
MOST_SHOWN = 30


def compiled(pattern: str, lang: str) -> re.Pattern:
    """The pattern, or after a warning one that matches nothing: a language with one bad pattern keeps its others."""
    return errors.ok_warn(lambda: re.compile(pattern), f"a pattern of {lang}") or re.compile(r"(?!)")


@lru_cache(64)
def _patterns(lang: str) -> dict[str, list[re.Pattern]]:
    spec = BY_NAME[lang]
    by_kind = {
        "reference": spec.references, "declare": [rf"(?<![\w.$@]){d}" for d in spec.declares], "keyed": spec.keyed, "object": [spec.object_alias] if spec.object_alias else [], "extra": spec.extra_bindings,
        "reassign": [spec.reassigns.replace("%s", spec.identifier)], "import": spec.imports, "export": spec.exports, "identifier": [rf"(?<![\w$.])(?<![\w$]\s\.)({spec.identifier})" + (r"(?![\"'])" if lang == "python" else "")],
    }
    return {kind: [compiled(p, lang) for p in patterns] for kind, patterns in by_kind.items()}


def _listed(text: str, at: int) -> Iterator[tuple[str, str, tuple[int, int], tuple[int, int]]]:
    """(name, local name, span of the name, span of the local one) of a list of names with `as`."""
    for m in re.finditer(r"(?:\btype\s+)?([A-Za-z_$*][\w$]*)(?:\s+as\s+([\w$]+)|\s*:\s*([\w$]+))?(?:\s*=\s*[^,]*)?", text):
        group = 2 if m[2] else 3 if m[3] else 1
        yield m[1], m[group], (at + m.start(1), at + m.end(1)), (at + m.start(group), at + m.end(group))


def _value_end(bare: str, i: int, pairs: dict[int, int]) -> int:
    """Where an expression that starts at i ends: at a comma, a semicolon, a closing bracket or a line's end after which nothing carries on."""
    for _ in range(len(bare)):
        m = re.compile(r"[,;\n()\[\]{}]").search(bare, i)
        if not m:
            return len(bare)
        c, at = m[0], m.start()
        if c in "([{":
            if at not in pairs:
                return len(bare)
            i = pairs[at] + 1
        elif c == "\n":
            before, after = bare[max(0, at - 200) : at].rstrip(), bare[at : at + 200].lstrip()
            if not ((before and before[-1] in "=+-*/%&|^<>?:,.([{!~") or (after and after[0] in ".?:+-*/%&|=<>" and after[:2] not in ("//", "++", "--"))):
                return at
            i = at + 1
        else:
            return at
    return len(bare)


def _items(bare: str, span: tuple[int, int], pairs: dict[int, int]) -> Iterator[tuple[int, int]]:
    """What stands between the commas of a list."""
    start = i = span[0]
    for m in re.compile(r"[,(\[{]").finditer(bare, *span):
        if m.start() < i:
            continue
        if m[0] == ",":
            yield start, m.start()
            start = i = m.end()
        else:
            i = pairs.get(m.start(), span[1]) + 1
    yield start, span[1]


def _declarators(code: Code, pairs: dict[int, int]) -> Iterator[tuple[tuple[int, int], bool, tuple[int, int], int]]:
    """(span of the name or of the inside of a pattern, whether it is a pattern, span of the value, start) of JavaScript declarations."""
    bare = code.bare
    ident, space, typed = re.compile(r"[A-Za-z_$][\w$]*"), re.compile(r"\s*"), re.compile(r"\s*!?\s*:\s*(?:[^=,;\n<{]|<[^<>]*>|\{[^{}]*\})*")
    for m in re.finditer(r"(?<![\w$.])(?:const|let|var)\s+", bare):
        p = m.end()
        while p < len(bare):
            p = space.match(bare, p).end()
            start = p
            if bare[p : p + 1] in ("{", "["):
                close = pairs.get(p)
                if close is None:
                    break
                name, pattern, p = (p + 1, close), bare[p] == "{", close + 1
            elif i := ident.match(bare, p):
                name, pattern, p = i.span(), False, i.end()
            else:
                break
            if t := typed.match(bare, p):
                p = t.end()
            e = re.compile(r"\s*=(?![=>])\s*").match(bare, p)
            if not e:
                if not re.compile(r"\s*,").match(bare, p):
                    break
                p = bare.index(",", p) + 1
                continue
            end = _value_end(bare, e.end(), pairs)
            yield name, pattern, (e.end(), end), start
            if bare[end : end + 1] != ",":
                break
            p = end + 1


# The statements of Python that are scopes, and which of them a later part belongs to.
_PYTHON_SCOPES = {"def": "Function", "class": "Class", "for": "Loop", "while": "Loop", "if": "Conditional", "try": "Conditional", "with": "Block"}
_PYTHON_MORE = {"elif": ("if",), "else": ("if", "for", "while", "try"), "except": ("try",), "finally": ("try",)}


def _python_scopes(code: Code, pairs: dict[int, int]) -> list[tuple[str, int, int]]:
    bare, out, stack, covered, at, last = code.bare, [], [], -1, 0, 0
    closing = sorted(pairs.items())
    starts = [a for a, _ in closing]
    for line in bare.splitlines(keepends=True):
        begin, end, body = at, at + len(line.rstrip()), line.strip()
        at += len(line)
        if not body or begin < covered:
            last = max(last, end) if body else last
            continue
        indent = len(line) - len(line.lstrip())
        word = re.match(r"(?:async\s+)?(\w+)", body)
        word = word[1] if word else ""
        while stack and (stack[-1][0] > indent or stack[-1][0] == indent and not (word in _PYTHON_MORE and stack[-1][3] in _PYTHON_MORE[word])):
            _, kind, a, _ = stack.pop()
            out.append((kind, a, last))
        i = bisect_right(starts, begin - 1)
        while i < len(closing) and closing[i][0] < end:
            if closing[i][1] > end:  # a logical line of several
                covered = max(covered, closing[i][1])
                end = max(end, closing[i][1])
            i += 1
        if word in _PYTHON_SCOPES and re.search(r":\s*(?:$|\S)", bare[begin : bare.find("\n", end) if bare.find("\n", end) >= 0 else len(bare)]):
            stack.append((indent, _PYTHON_SCOPES[word], begin + indent, word))
        last = max(last, end)
    while stack:
        _, kind, a, _ = stack.pop()
        out.append((kind, a, last))
    return out


def _kind_of(lead: str, spec: Language) -> str | None:
    depth = 0
    for i in range(len(lead) - 1, -1, -1):  # what stands in an open bracket is an expression of its own
        depth += (lead[i] in ")]") - (lead[i] in "([")
        if depth < 0:
            lead = lead[i + 1 :]
            break
    if lead.rstrip().endswith(("=>", "->")):
        return "Function"
    for w in re.findall(r"\w+", lead):
        if w in spec.scope_words:
            return spec.scope_words[w]
    if _METHOD.search(lead):
        return "Function"
    return None if lead.strip() else "Block"


def _scopes(code: Code, spec: Language, pairs: dict[int, int]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of blocks, by indentation, by closing words or by braces. A block starts where its statement does."""
    bare, out = code.bare, []
    if spec.indented:
        out = _python_scopes(code, pairs)
    words = spec.closed_by_end or (_BASH_BLOCKS if spec.name == "bash" else None)
    if words:
        stack, line = [], 0
        for m in re.finditer(rf"\n|{words}", bare):
            if m[0] == "\n":
                line = m.end()
                continue
            word = m[0].strip()
            if word in _CLOSERS:
                if stack:
                    kind, start = stack.pop()
                    out.append((kind, start, m.end()))
                continue
            lead = bare[line : m.end()]
            if word == "do" and spec.name == "ruby" and re.match(r"\s*(?:while|until|for)\b", lead):
                continue
            found = [spec.scope_words[w] for w in re.findall(r"\w+", lead if word in ("do", "fn", "then") else word) if w in spec.scope_words and w != "do"]
            stack.append((found[0] if found else "Function" if word == "fn" else "Block", line + len(lead) - len(lead.lstrip()) if word == "do" else m.end() - len(word)))
    if not spec.indented and not spec.closed_by_end:
        hard, soft, depth = 0, 0, 0
        for m in re.finditer(r"[;{}\n()]", bare):
            c, at = m[0], m.start()
            if c in "()":
                depth += 1 if c == "(" else -1
            elif c == "{":
                lead, start = bare[max(hard, soft) : at], max(hard, soft)
                if not lead.strip():
                    lead, start = bare[hard:at], hard
                kind = _kind_of(lead, spec)
                if kind and at in pairs:
                    out.append((kind, start + len(lead) - len(lead.lstrip()) if lead.strip() else at, pairs[at] + 1))
                hard, depth = at + 1, 0
            elif c == "}" or (c == ";" and depth <= 0):
                hard = at + 1
                depth = 0
            elif c == "\n" and depth <= 0:
                soft = at + 1
    return sorted(out, key=lambda x: (x[1], -x[2]))


class _Nest:
    """Nested spans in order of start: ids from 2, the file is 1."""

    def __init__(self, blocks: list[tuple[str, int, int]]):
        self.starts, self.ends, self.parents, stack = [a for _, a, _ in blocks], [b for _, _, b in blocks], [], []
        for i, (_, a, b) in enumerate(blocks):
            while stack and self.ends[stack[-1]] < b:
                stack.pop()
            self.parents.append(stack[-1] + 2 if stack else 1)
            stack.append(i)

    def at(self, place: int) -> int:
        i = bisect_right(self.starts, place) + 1
        while i > 1 and self.ends[i - 2] <= place:
            i = self.parents[i - 2]
        return max(i, 1)

    def path(self, i: int) -> list[int]:
        out = [i]
        while out[-1] > 1:
            out.append(self.parents[out[-1] - 2])
        return out


def scanned(content: str, spec: Language) -> Code:
    return scan(content, spec.name, spec.line_comments, spec.block_comment)


def facts(file_id: int, lang: str, content: str | None, use_imports: bool = False) -> list[tuple]:
    """All rows of one file. With `use_imports`, names that an import makes stand for an environment object or module count as such."""
    spec = BY_NAME.get(lang)
    if not content or not spec:
        return []
    code = scanned(content, spec)
    text, bare, ends = code.text, code.bare, [m.start() for m in re.finditer("\n", content)]
    pairs, alone = code.brackets()
    p = _patterns(lang)
    out: list[tuple] = []
    keywords = _KEYWORDS_OF[lang]
    blocks = _scopes(code, spec, pairs)
    nest = _Nest(blocks)

    def at(o: int) -> tuple[int, int]:
        line = bisect_right(ends, o - 1)
        return line, o - (ends[line - 1] + 1 if line else 0)

    def add(kind: str, span: tuple[int, int], name_span: tuple[int, int], name: str | None, key=None, source=None, module=None, alias=None, key_span=None) -> None:
        k = (*at(key_span[0]), *at(key_span[1])) if key_span else (None,) * 4
        out.append((file_id, kind, len(out), name, key, source, module, alias, *at(span[0]), *at(span[1]), *at(name_span[0]), *at(name_span[1]), *k, nest.at(name_span[0]), None, None))

    def each(kind: str) -> Iterator[re.Match]:
        for r in p[kind]:
            for m in r.finditer(text):
                first = m.start() + len(m[0]) - len(m[0].lstrip())
                if not code.is_dead(first):
                    yield m

    aliases: dict[str, str] = {}
    for m in each("import"):
        groups = m.groupdict()
        module = groups["path"]
        if (names := groups.get("list") or groups.get("more")) is not None:
            start = m.start("list") if groups.get("list") is not None else m.start("more")
            for name, local, _, span in _listed(names, start):
                add("import", m.span(), span, name, module=module, alias=local)
                aliases[local] = module
        else:
            local = groups.get("alias") or re.split(r"[./:\\]", module.rstrip("/*"))[-1 if spec.name != "python" else 0]
            add("import", m.span(), m.span("alias") if groups.get("alias") else m.span("path"), module, module=module, alias=local)
            aliases[local] = module

    def known(m: re.Match) -> bool:
        o = m.groupdict().get("object")
        return not o or o in spec.objects or (use_imports and aliases.get(o) in spec.modules)

    def whole(m: re.Match) -> int:
        """The end of a match with the bracket closed that it leaves open."""
        for i in range(m.start(), m.end()):
            if i in pairs and pairs[i] >= m.end() and bare[i] in "([":
                return pairs[i] + 1
        return m.end()

    read: set[int] = set()
    for m in each("reference"):
        if known(m) and m.start("name") not in read:
            read.add(m.start("name"))
            add("reference", (m.start(), whole(m)), m.span("name"), m["name"])
    if spec.name == "ruby":
        for m in re.finditer(r"(?<!\w)ENV\.values_at\(([^()]*)\)", text):
            for k in re.finditer(r"[\"'](\w+)[\"']", m[1]) if not code.is_dead(m.start()) else ():
                add("reference", m.span(), (m.start(1) + k.start(1), m.start(1) + k.end(1)), k[1])

    def valued(span: tuple[int, int], target: tuple[int, int], v: int, strict: bool) -> None:
        """What the value at v makes of the target: a binding, an alias of the object, a destructuring or an assignment."""
        name = text[slice(*target)]
        for r in p["reference"]:
            if (m := r.match(text, v)) and known(m):
                end = whole(m)
                if not strict or _END.match(bare, end):
                    add("binding", (span[0], end), target, name, key=m["name"])
                    return
        for r in p["object"]:
            if (m := r.match(text, v)) and _END.match(bare, m.end()):
                add("object", (span[0], m.end()), target, name, source=spec.default_object)
                return
        for r in p["keyed"]:
            if (m := r.match(text, v)) and m["source"] not in spec.objects and _END.match(bare, whole(m)):
                add("destructure", (span[0], whole(m)), target, name, key=m["key"], source=m["source"], key_span=m.span("key"))
                return
        m = re.compile(rf"(?:\$\{{?)?({spec.identifier}|[A-Za-z_]\w*)\}}?\"?" if spec.name == "bash" else rf"({spec.identifier})").match(text, v)
        clone = re.compile(r"\.clone\(\)").match(text, m.end()) if m and spec.name == "rust" else None
        if m and m[1] not in keywords and _END.match(bare, clone.end() if clone else m.end()):
            add("assignment", (span[0], m.end()), target, name, source=m[1])

    targets: set[int] = set()  # where declared names stand, and all that stands in their declarations before the value
    if spec.is_js:
        for name, pattern, (a, b), start in _declarators(code, pairs):
            targets.update(range(name[0], a) if not pattern else (name[0],))
            value = text[a:b].strip()
            bare_value = _TAIL.sub("", value).strip() if spec.name != "javascript" else value
            source = re.fullmatch(spec.identifier, bare_value)
            env = p["object"][0].fullmatch(bare_value)
            if not pattern:
                ref = next((m for r in p["reference"] if (m := r.fullmatch(bare_value))), None)
                if ref:
                    add("binding", (start, b), name, text[slice(*name)], key=ref["name"])
                elif env:
                    add("object", (start, b), name, text[slice(*name)], source=spec.default_object)
                elif source and bare_value not in keywords:
                    add("assignment", (start, b), name, text[slice(*name)], source=bare_value)
                continue
            for i, j in _items(bare, name, pairs) if env or source else ():
                m = _PROPERTY.fullmatch(text[i:j])
                if m:
                    local = "local" if m["local"] else "key"
                    key, span = (i + m.start("key"), i + m.end("key")), (i + m.start(local), i + m.end(local))
                    targets.add(span[0])
                    add("binding" if env else "destructure", (start, b), span, m[local], key=m["key"], source=None if env else bare_value, key_span=key)
        for m in re.finditer(rf"(?<![\w$.])(?P<target>{spec.identifier})\s*=(?![=>])\s*(?P<source>{spec.identifier})(?![\w$.(\[])", bare):
            if m.start("target") not in targets and m["source"] not in keywords and _END.match(bare, m.end()):
                add("assignment", m.span(), m.span("target"), m["target"], source=m["source"])
        for m in re.finditer(rf"(?<![\w$.])(?P<target>{spec.identifier})\s*=(?![=>])|(?<![\w$.])(?P<up>{spec.identifier})(?:\+\+|--)|(?:\+\+|--)(?P<down>{spec.identifier})", bare):
            group = "target" if m["target"] else "up" if m["up"] else "down"
            before = bare[max(0, m.start() - 200) : m.start()].rstrip(" \t")
            if m.start(group) not in targets and m[group] not in keywords and (group != "target" or not before or before[-1] in ";{}\n=&|?:!)"):
                add("reassignment", m.span(group), m.span(group), m[group])
    else:
        strict = spec.name == "python"
        for m in each("declare"):
            start = m.start("target")
            # of several targets on one left side none takes the first value
            beside = spec.name in ("python", "ruby", "lua", "elixir") and re.search(r",[ \t]*$", text[max(0, start - 40) : start])
            if start in targets or m["target"] in keywords or beside or code.is_dead(start):
                continue
            targets.update(range(start, m.end()))
            valued((start, m.end()) if strict else m.span(), m.span("target"), m.end(), strict)
        for m in each("extra"):
            v = next((x for r in p["reference"] if (x := r.match(text, m.start("value")))), None)
            if v:
                add("binding", m.span(), m.span("target"), m["target"], key=v["name"])
        for m in p["reassign"][0].finditer(bare):
            if m["target"] not in keywords:
                add("reassignment", m.span("target"), m.span("target"), m["target"])

    for m in each("export"):
        groups = m.groupdict()
        value, module = (groups.get("value") or "").strip().rstrip(";").strip(), groups.get("path")
        source = _TAIL.sub("", value).strip() if value else groups.get("local")
        if groups.get("wild"):
            add("wildcard", m.span(), m.span(), None, module=module)
        elif groups.get("list") is not None:
            for name, local, _, span in _listed(groups["list"], m.start("list")):
                add("export", m.span(), span, local, source=name, module=module)
        elif groups.get("pattern") is not None:
            for _, local, _, span in _listed(groups["pattern"], m.start("pattern")):
                add("export", m.span(), span, local, source=local)
        elif groups.get("default"):
            local = groups.get("local") or (source if source and re.fullmatch(spec.identifier, source) else None)
            add("export", m.span(), m.span(), "default", key=source, source=local)
        else:
            add("export", m.span(), m.span("export"), m["export"], key=source, source=groups.get("local") or m["export"], module=module)
    for i, (kind, a, b) in enumerate(blocks):
        add("scope", (a, b), (a, b), kind)
        out[-1] = (*out[-1][:-3], nest.parents[i], i + 2, nest.path(i + 2))
    for m in p["identifier"][0].finditer(bare):
        if m[1] not in keywords:
            add("identifier", m.span(1), m.span(1), m[1])
    if spec.is_js:
        for m in re.finditer(r"(?<![\w$.])([A-Za-z_$][\w$]*)(?:\s*\??\.\s*([A-Za-z_$][\w$]*)|\[\s*[\"'](\w+)[\"']\s*\])", text):
            if not code.is_dead(m.start()) and m[1] not in keywords - {"this"}:
                group = 2 if m[2] else 3
                add("property", m.span(), m.span(group), m[group], source=m[1])
    for place, c in alone:
        if c in ")]}":
            add("error", (place, place + 1), (place, place + 1), f"Unexpected: {shortened(text[place:])}")
        else:
            add("error", (place, place + 1), (place, place + 1), f"Missing: {dict(zip('([{', ')]}', strict=True))[c]}")
    for place in code.open_strings:
        add("error", (place, place + 1), (place, place + 1), f"Unexpected: {shortened(text[place:])}")
    return out


def shortened(text: str, most: int = MOST_SHOWN) -> str:
    text = text.split("\n")[0]
    return text if len(text) <= most else text[:most] + "..."


def extract(files: DataFrame, use_imports: bool = False) -> DataFrame:
    """Facts of all files (file_id, lang, content), in one pass. Imports are only heeded if so told, as for open documents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for file_id, lang, content in zip(frame["file_id"], frame["lang"], frame["content"], strict=True):
                rows += facts(file_id, lang, content, use_imports)
                if len(rows) > 200_000:  # a task holds the facts of few files at a time
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return files.select("file_id", "lang", "content").mapInPandas(run, SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=FIELDS)
    return out.astype({c: "Int32" for c in ("ksl", "ksc", "kel", "kec", "own")})


def completion_context(lang: str, line: str | None, character: int) -> str | None:
    """The object or module before the cursor after which names of variables complete, or null; `line` is the cursor's line."""
    spec = BY_NAME.get(lang)
    if not spec or line is None or character < 0:
        return None
    before = line[:character]
    if any(a < character <= b for a, b in scanned(line, spec).comments):
        return None
    if spec.name == "bash":
        return "$" if re.search(r"\$\{?\w*$", before) else None
    for trigger in sorted(spec.triggers, key=len, reverse=True):
        m = re.search(rf"(?P<object>[A-Za-z_$][\w$.:!]*?)\s*{re.escape(trigger)}(?P<part>\w*)$", before)
        if m:
            said = m["object"].rstrip(".")
            inside = [o for o in spec.objects if said == o or said.startswith((o + ".", o + "::"))]
            return max(inside, key=len) if inside else said
    return None


def property_at(lang: str, line: str | None, character: int) -> tuple[str, str] | None:
    """(object, property) of the access that the cursor stands on, in the languages that know such accesses."""
    spec = BY_NAME.get(lang)
    if not spec or line is None or lang not in ("javascript", "typescript", "typescriptreact", "python", "go", "lua", "php", "ruby", "rust"):
        return None
    code = scanned(line, spec)
    for m in re.finditer(rf"(?<![\w$.])({spec.identifier}(?:\.[A-Za-z_]\w*)*)(?:\.([A-Za-z_$][\w$]*)|\[\s*[\"':]?(\w+)[\"']?\s*\])", code.text):
        if m.start() <= character < m.end() and not code.is_dead(m.start()):
            return m[1], m[2] or m[3]
    return None


def is_env_source(lang: str, value: str | None) -> str | None:
    """Object or Variable where the text of a value is the environment's object or one access to it, else null."""
    spec = BY_NAME.get(lang)
    if not spec or not value:
        return None
    p = _patterns(lang)
    if any(r.fullmatch(value.strip()) for r in p["object"]) or value.strip() in spec.objects:
        return "Object"
    return "Variable" if any(r.match(value.strip()) for r in p["reference"]) else None


def with_env_source(values: DataFrame, value: str = "value") -> DataFrame:
    """Adds source, is_env_source() of the column `value` in the language of the column lang."""

    def run(lang: pd.Series, said: pd.Series) -> pd.Series:
        return pd.Series([is_env_source(a, b) for a, b in zip(lang, said, strict=True)], dtype=object)

    return values.withColumn("source", F.pandas_udf(run, "string")("lang", value))


def by_cursor(probes: DataFrame, contents: DataFrame) -> DataFrame:
    """Adds context, object and property to probes (file_id, probe_id, line, character), from the cursor's line alone.

    contents: file_id, lang, content. Only lines that a probe stands on leave the join.
    """
    lines = probes.join(contents, "file_id").select("file_id", "probe_id", "character", "lang", F.get(F.split("content", "\r?\n"), F.col("line")).alias("said"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for file_id, probe, character, lang, said in zip(f["file_id"], f["probe_id"], f["character"], f["lang"], f["said"], strict=True):
                found = property_at(lang, said, character) or (None, None)
                rows.append((file_id, probe, completion_context(lang, said, character), *found))
            yield pd.DataFrame(rows, columns=["file_id", "probe_id", "context", "object", "property"])

    found = lines.mapInPandas(run, "file_id bigint, probe_id bigint, context string, object string, property string")
    return probes.join(found, ["file_id", "probe_id"], "left")


def language_of(path: Column, language_id: Column | None = None) -> Column:
    """The language of a path by its exact extension, or of a language id where that is known; null if neither is."""
    pairs = F.create_map(*[F.lit(x) for e, spec in BY_EXTENSION.items() for x in (e, spec.name)])
    out = F.try_element_at(pairs, F.regexp_extract(path, r"\.([^./]+)$", 1))
    if language_id is None:
        return out
    ids = F.create_map(*[F.lit(x) for i, spec in BY_ID.items() for x in (i, spec.name)])
    return F.coalesce(F.try_element_at(ids, language_id), out)


def with_language(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds lang by exact extension; files of no known language have null."""
    return files.withColumn("lang", language_of(F.col(path)))
