"""What of a source text is code: comments blanked, strings known, brackets paired. One scan a text, for any of the languages."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache

_DOUBLE, _SINGLE = r'"(?:\\[\s\S]|[^"\\\n])*+"', r"'(?:\\[\s\S]|[^'\\\n])*+'"


def _interpolated(opener: str, quote: str = '"', lines: bool = False) -> str:
    """A quoted string in which opener...} is code; that may hold quotes and one more level of braces."""
    return rf"{quote}(?>{opener}(?>[^{{}}]|\{{[^{{}}]*\}})*+\}}|\\[\s\S]|[^{quote}\\{'' if lines else chr(92) + 'n'}])*+{quote}"


#: By language: string forms in order of trial, and what opens code inside them.
_STRINGS = {
    "js": ((_interpolated(r"\$\{", "`", True), _DOUBLE, _SINGLE), r"\$\{"),
    "python": ((r'[rRbBuUfF]{0,2}"""[\s\S]*?(?<!\\)"""', r"[rRbBuUfF]{0,2}'''[\s\S]*?(?<!\\)'''", rf"[fF][rR]?{_DOUBLE}", rf"[fF][rR]?{_SINGLE}", _DOUBLE, _SINGLE), r"(?<!\{)\{"),
    "rust": ((r'b?r(?P<hashes>#*)"[\s\S]*?"(?P=hashes)', r'"(?:\\[\s\S]|[^"\\])*+"', r"'(?:\\[^']+|[^'\\\n])'"), None),
    "go": ((r"`[^`]*`", _DOUBLE, _SINGLE), None),
    "lua": ((r"\[(?P<equals>=*)\[[\s\S]*?\](?P=equals)\]", _DOUBLE, _SINGLE), None),
    "php": ((_interpolated(r"\{(?=\$)", '"', True), r"'(?:\\[\s\S]|[^'\\])*+'"), r"\{(?=\$)"),
    "ruby": ((_interpolated(r"#\{", '"', True), r"'(?:\\[\s\S]|[^'\\])*+'"), r"#\{"),
    "bash": ((r"\$?'[^']*'",), None),  # double quotes hold code throughout
    "c": ((_DOUBLE, _SINGLE), None),
    "java": ((r'"""[\s\S]*?(?<!\\)"""', _DOUBLE, _SINGLE), None),
    "kotlin": ((r'"""[\s\S]*?"""', _interpolated(r"\$\{"), _SINGLE), r"\$\{"),
    "csharp": ((r'\$?@"(?:""|[^"])*+"', r"\$" + _interpolated(r"(?<!\{)\{"), _DOUBLE, _SINGLE), r"(?<!\{)\{"),
    "elixir": ((r'"""[\s\S]*?"""', _interpolated(r"#\{", '"', True), _SINGLE), r"#\{"),
    "zig": ((r"\\\\[^\n]*", _DOUBLE, _SINGLE), None),
}
_ALIKE = {"javascript": "js", "typescript": "js", "typescriptreact": "js", "cpp": "c"}
_REGEX = r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])+/[a-z]*"
#: By language: what announces a document that starts on the next line, the line that ends it, and what is code inside it unless its word is quoted.
_HERE = {
    "bash": (r"(?<!<)<<-?[ \t]*(?P<quote>[\"'\\]?)(?P<tag>[A-Za-z_]\w*)[\"']?", r"^[ \t]*{}[ \t]*\r?$", re.compile(r"(?<!\\)\$(?:\{[^{}]*\}|\([^()]*\)|\w+)"), "\"'\\"),
    "php": (r"<<<[ \t]*(?P<quote>[\"']?)(?P<tag>[A-Za-z_]\w*)(?P=quote)", r"^[ \t]*{}(?!\w)", None, "'"),
    "ruby": (r"<<[~-]?(?P<quote>[\"'`]?)(?P<tag>[A-Za-z_]\w*)(?P=quote)", r"^[ \t]*{}[ \t]*\r?$", None, "'"),
}
_PAIRS = {")": "(", "]": "[", "}": "{"}


@dataclass
class Code:
    """A scanned text: `text` with comments blanked, `bare` with the insides of strings blanked as well."""

    text: str
    bare: str
    dead: list[tuple[int, int]]  # insides of strings that are no code
    comments: list[tuple[int, int]]
    open_strings: list[int]  # where a quote stands that nothing closes
    _starts: list[int] = field(default_factory=list)

    def is_dead(self, at: int) -> bool:
        if len(self._starts) != len(self.dead):
            self._starts = [a for a, _ in self.dead]
        i = bisect_right(self._starts, at) - 1
        return i >= 0 and self.dead[i][0] <= at < self.dead[i][1]

    def brackets(self) -> tuple[dict[int, int], list[tuple[int, str]]]:
        """{opening place: closing place}, and the brackets without a partner."""
        pairs, stack, alone = {}, [], []
        for m in re.finditer(r"[()\[\]{}]", self.bare):
            c = m[0]
            if c in "([{":
                stack.append((m.start(), c))
            elif stack and stack[-1][1] == _PAIRS[c]:
                pairs[stack.pop()[0]] = m.start()
            else:
                alone.append((m.start(), c))
        return pairs, sorted(alone + stack)


@lru_cache(64)
def _scanner(lang: str, line_comments: tuple[str, ...], block: tuple[str, str] | None) -> tuple[re.Pattern, re.Pattern | None]:
    strings, opener = _STRINGS[_ALIKE.get(lang, lang)]
    parts = []
    if block:
        parts.append(rf"(?P<block>{re.escape(block[0])}[\s\S]*?(?:{re.escape(block[1])}|\Z))")
    if lang == "ruby":
        parts.append(r"(?P<begin>^=begin[\s\S]*?(?:^=end[^\n]*|\Z))")
    lead = r"(?<![^\s;(|&`])" if lang == "bash" else ""
    parts += [rf"(?P<line{i}>{lead}{re.escape(c)}[^\n]*)" for i, c in enumerate(line_comments)]
    if lang in _HERE:
        parts.append(f"(?P<here>{_HERE[lang][0]})")
    parts += [f"(?P<s{i}>{s})" for i, s in enumerate(strings)]
    if _ALIKE.get(lang) == "js":
        parts.append(f"(?P<regex>{_REGEX})")
    parts.append("(?P<stray>[\"'`])" if lang not in ("bash", "rust") else '(?P<stray>")' if lang == "rust" else "(?P<stray>')")
    return re.compile("|".join(parts), re.M), re.compile(rf"{opener}(?>[^{{}}]|\{{[^{{}}]*\}})*+\}}") if opener else None


def scan(text: str, lang: str, line_comments: tuple[str, ...], block: tuple[str, str] | None) -> Code:
    """Positions stay as they are. A JavaScript regular expression counts as a string where an operand may start.

    Here-documents are strings from the line after the one that announces them; one that nothing ends is none.
    """
    pattern, live = _scanner(lang, line_comments, block)
    out, bare, dead, comments, stray, at, done = [], [], [], [], [], 0, 0

    def blank(s: str) -> str:
        return re.sub(r"[^\n]", " ", s)

    def strung(a: int, b: int, codes: list[tuple[int, int]]) -> str:
        """The text from a to b with all but `codes` blanked."""
        spans, inside = [], a
        for x, y in codes:
            spans.append((inside, x))
            inside = y
        spans = [(x, y) for x, y in [*spans, (inside, b)] if y > x]
        dead.extend(spans)
        piece, last = [], a
        for x, y in spans:
            piece += [text[last:x], blank(text[x:y])]
            last = y
        return "".join(piece) + text[last:b]

    def documents(begin: int) -> int:
        """Takes in the announced here-documents, the first of which begins there; returns where the scan goes on."""
        nonlocal done
        _, closing, code, silent = _HERE[lang]
        for tag, quote in announced:
            end = re.compile(closing.format(re.escape(tag)), re.M).search(text, begin)
            if not end:
                break
            code = code or live
            codes = [x.span() for x in code.finditer(text, begin, end.start())] if not quote or quote not in silent else []
            out.append(text[done : end.start()])
            bare.append(text[done:begin] + strung(begin, end.start(), codes))
            done, begin = end.start(), end.end()
        return done

    announced: list[tuple[str, str]] = []
    line_end = 0
    while True:
        m = pattern.search(text, at)
        if announced and (not m or m.start() >= line_end):
            at = max(at, documents(line_end)) if line_end >= done else at
            announced.clear()
            continue
        if not m:
            break
        kind, a, b = m.lastgroup, m.start(), m.end()
        if kind == "here":
            at = b
            line_end = line_end if announced else text.find("\n", b) + 1
            if line_end:
                announced.append((m["tag"], m["quote"]))
            continue
        if kind in ("hashes", "equals"):
            kind = "s0"
        at = max(b, a + 1)
        if kind == "regex":
            before = text[max(0, a - 40) : a].rstrip()
            if before and before[-1] not in "=(,:;!&|?{}[+-*~^<>%" and not re.search(r"\b(?:return|typeof|case|in|of)$", before):
                at = a + 1  # a division
                continue
        if kind == "stray":
            stray.append(a)
            continue
        out.append(text[done:a])
        bare.append(text[done:a])
        if kind == "block" or kind == "begin" or kind.startswith("line"):
            comments.append((a, b))
            out.append(blank(m[0]))
            bare.append(blank(m[0]))
        else:
            out.append(m[0])
            lead = next((k for k, c in enumerate(m[0]) if c in "\"'`[/\\"), 0)
            edge = 3 if m[0][lead : lead + 3] in ('"""', "'''") else 1
            codes = []
            if live and kind != "regex" and (lang != "python" or "f" in m[0][:lead].lower()):
                codes = [(a + x.start(), a + x.end()) for x in live.finditer(m[0])]
            inside = a + lead + edge
            bare.append(text[a:inside] + strung(inside, b - edge, codes) + text[max(inside, b - edge) : b])
        done = b
    out.append(text[done:])
    bare.append(text[done:])
    return Code("".join(out), "".join(bare), dead, comments, stray)
