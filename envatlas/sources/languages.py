"""What the engine knows of each language, and the patterns its extractor looks for.

Extraction works on tokens, not on syntax trees: comments are blanked, the insides of strings are no code, and each pattern's
matches become rows.
"""

from __future__ import annotations

from dataclasses import dataclass

_S = r"""["'`](?P<name>[A-Za-z_][A-Za-z0-9_]*)["'`]"""
_ID = r"[A-Za-z_$][A-Za-z0-9_$]*"
_END = r"(?=\s*(?:[;,)\n}]|\bas\b|!|$))"
#: Kinds of a scope by the word that opens it.
_WORDS = {
    "function": "Function", "fn": "Function", "func": "Function", "fun": "Function", "def": "Function", "defp": "Function", "lambda": "Function", "class": "Class", "struct": "Class", "enum": "Class", "interface": "Class", "trait": "Class", "impl": "Class", "object": "Class", "record": "Class",
    "for": "Loop", "foreach": "Loop", "while": "Loop", "until": "Loop", "loop": "Loop", "do": "Loop", "repeat": "Loop", "if": "Conditional", "elif": "Conditional", "elsif": "Conditional", "else": "Conditional", "unless": "Conditional", "switch": "Conditional", "match": "Conditional", "when": "Conditional", "case": "Conditional", "select": "Conditional", "catch": "Block",
    "try": "Block", "with": "Block", "finally": "Block", "except": "Block", "unsafe": "Block", "begin": "Block", "namespace": "Block", "module": "Block", "defmodule": "Class",
}


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    ids: tuple[str, ...]
    objects: tuple[str, ...]
    default_object: str | None
    modules: tuple[str, ...]
    triggers: tuple[str, ...]
    references: tuple[str, ...]
    #: Patterns with `target`, after which the value of a binding, assignment or destructuring stands.
    declares: tuple[str, ...] = ()
    line_comments: tuple[str, ...] = ("//",)
    block_comment: tuple[str, str] | None = ("/*", "*/")
    object_alias: str | None = None
    #: What may follow the name of an assigned variable, or what a value keyed off an object looks like (groups source, key).
    keyed: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    exports: tuple[str, ...] = ()
    extra_bindings: tuple[str, ...] = ()
    reassigns: str = r"(?m)(?:^|[;{}])[ \t]*(?P<target>%s)\s*=(?![=>~])"
    indented: bool = False
    any_assignment_reassigns: bool = False
    identifier: str = _ID
    closed_by_end: str | None = None
    quotes: str = "\"'"

    @property
    def scope_words(self) -> dict[str, str]:
        return _WORDS

    @property
    def is_js(self) -> bool:
        return self.name in ("javascript", "typescript", "typescriptreact")


_JS_REFS = (r"process\.env\.(?P<name>[A-Za-z_][A-Za-z0-9_]*)", rf"process\.env\[\s*{_S}\s*\]", r"import\.meta\.env\.(?P<name>[A-Za-z_][A-Za-z0-9_]*)")
#: The head of a compound statement whose body follows on its line.
_SUITE = r"^[ \t]*(?:async[ \t]+)?(?:if|elif|else|for|while|with|try|except|finally)\b[^\n#]*?:(?=[ \t])"
_PY_CALL = r"\.(?:get|pop|setdefault)\(\s*"
_PY_REFS = (
    rf"(?P<module>\w+)\.environ{_PY_CALL}{_S}", rf"(?P<module>\w+)\.environ\[\s*{_S}\s*\]", rf"(?P<module>\w+)\.getenv\(\s*{_S}", rf"(?<![\w.])(?P<object>\w+)\[\s*{_S}\s*\]", rf"(?<![\w.])(?P<object>\w+){_PY_CALL}{_S}",
    rf"dotenv\.get_key\([^,()]*,\s*{_S}", rf"dotenv_values\([^()]*\)\[\s*{_S}\s*\]", rf"(?<![\w.])config\(\s*{_S}", rf"(?<!\w)decouple\.config\(\s*{_S}",
)
_JS_IMPORTS = (
    rf"import\s+(?:type\s+)?(?P<alias>{_ID})\s*(?:,\s*\{{[^}}]*\}}\s*)?from\s*[\"'](?P<path>[^\"']+)[\"']", rf"import\s+(?:{_ID}\s*,\s*)?\*\s*as\s+(?P<alias>{_ID})\s+from\s*[\"'](?P<path>[^\"']+)[\"']",
    r"import\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{(?P<list>[^}]*)\}\s*from\s*[\"'](?P<path>[^\"']+)[\"']", rf"(?:const|let|var)\s+(?P<alias>{_ID})\s*=\s*require\(\s*[\"'](?P<path>[^\"']+)[\"']\s*\)", r"(?:const|let|var)\s*\{(?P<list>[^}]*)\}\s*=\s*require\(\s*[\"'](?P<path>[^\"']+)[\"']\s*\)",
)
_FROM = r"\s*from\s*[\"'](?P<path>[^\"']+)[\"']"
_JS_EXPORTS = (
    rf"export\s+(?:declare\s+)?(?:const|let|var)\s+(?P<export>{_ID})\s*(?::[^=;]+)?(?:=(?P<value>[^;\n]*))?", r"export\s+(?:const|let|var)\s*\{(?P<pattern>[^}]*)\}\s*=", rf"export\s+(?:async\s+)?(?:function\s*\*?|class|abstract\s+class)\s+(?P<export>{_ID})",
    rf"export\s+(?:declare\s+)?(?:interface|type|enum|namespace)\s+(?P<export>{_ID})", rf"export\s*(?:type\s*)?\{{(?P<list>[^}}]*)\}}(?:{_FROM})?", rf"export\s*(?P<wild>\*){_FROM}", rf"export\s*\*\s*as\s+(?P<export>{_ID}){_FROM}",
    rf"(?P<default>export\s+default)\s+(?:(?:async\s+)?function\s*\*?\s*|class\s+)(?P<local>{_ID})?", rf"(?P<default>export\s+default)\s+(?!function\b|class\b|async\b)(?P<value>[^;\n]+)", r"(?P<default>(?<![\w.$])module\.exports)\s*=(?!=)\s*(?P<value>[^;\n]+)",
    rf"(?<![\w.$])(?:module\.)?exports\.(?P<export>{_ID})\s*=(?!=)\s*(?P<value>[^;\n]+)",
)
_GETENV = (rf"(?<![\w.:])(?:secure_)?getenv\(\s*{_S}",)
_TYPED = rf"(?:(?:private|public|protected|internal|static|final|readonly|const)\s+)*[A-Za-z_][\w.]*(?:<[^<>;=]*>)?(?:\[\])?\??\s+(?P<target>{_ID})\s*=\s*"
_PLAIN = rf"(?P<target>{_ID})\s*=(?!=)\s*"
_VIEW = "public"
_PUBLIC = rf"(?m)^\s*{_VIEW}\s+(?:(?:static|final|abstract|sealed|override|virtual|async|const|readonly|partial)\s+)*"

# Extensions, ids, environment objects, modules and completion triggers by language.
LANGUAGES = (
    Language("javascript", ("js", "jsx", "mjs", "cjs"), ("javascript", "javascriptreact"), ("process.env", "import.meta.env"), "process.env", ("process",), (".", '["', "['"), (*_JS_REFS, rf"import\.meta\.env\[\s*{_S}\s*\]"), object_alias=r"(?:process|import\.meta)\.env", imports=_JS_IMPORTS, exports=_JS_EXPORTS, quotes="\"'`"),
    Language("typescript", ("ts", "mts", "cts"), ("typescript",), ("process.env", "import.meta.env"), "process.env", ("process",), (".", '"', "'"), _JS_REFS, object_alias=r"(?:process|import\.meta)\.env", imports=_JS_IMPORTS, exports=_JS_EXPORTS, quotes="\"'`"),
    Language("typescriptreact", ("tsx",), ("typescriptreact",), ("process.env", "import.meta.env"), "process.env", ("process",), (".", '"', "'"), _JS_REFS, object_alias=r"(?:process|import\.meta)\.env", imports=_JS_IMPORTS, exports=_JS_EXPORTS, quotes="\"'`"),
    Language(
        "python", ("py",), ("python",), ("os.environ", "os"), "os.environ", ("os", "dotenv", "decouple"), (".", '["', "['", '("', "('"), _PY_REFS, (rf"(?m:{_SUITE}|^|(?<=;))[ \t]*(?P<target>[A-Za-z_]\w*)\s*(?::[^=\n()]+?)?\s*=(?!=)\s*", r"(?P<target>[A-Za-z_]\w*)\s*:=\s*"), ("#",), None, r"os\.environ(?:\.copy\(\s*\))?",
        (r"(?P<source>[A-Za-z_]\w*)\[\s*[\"'](?P<key>\w+)[\"']\s*\]", rf"(?P<source>[A-Za-z_]\w*){_PY_CALL}[\"'](?P<key>\w+)[\"']"),
        (r"(?m)^[ \t]*import\s+(?P<path>[\w.]+)(?:\s+as\s+(?P<alias>\w+))?", r"(?m)^[ \t]*from\s+(?P<path>[\w.]+)\s+import\s+(?:\((?P<list>[^()]*)\)|(?P<more>[^()\n#]+))"), (r"(?m)^(?P<export>[A-Za-z_]\w*)\s*(?::[^=\n]+)?=(?!=)\s*(?P<value>[^\n]*)", r"(?m)^(?:async\s+)?(?:def|class)\s+(?P<export>\w+)"),
        indented=True, any_assignment_reassigns=True, identifier=r"[A-Za-z_]\w*", reassigns=rf"(?m)(?:{_SUITE}|^|;)[ \t]*(?P<target>%s)\s*(?::[^=\n]+)?=(?!=)",
    ),
    Language(
        "rust", ("rs",), ("rust",), ("std::env", "std", "env"), None, ("std::env", "env"), ('("', "('"), (rf"(?<![\w:])(?:std::)?(?P<module>\w+)::var(?:_os)?\(\s*{_S}", rf"(?:option_)?env!\(\s*{_S}", rf"(?<!\w)dotenvy?::var\(\s*{_S}"), (rf"let\s+(?:mut\s+)?(?P<target>{_ID})\s*(?::[^=;]+)?=\s*", rf"(?:pub\s+)?(?:const|static(?:\s+mut)?)\s+(?P<target>{_ID})\s*:[^=;]+=\s*", rf"if\s+let\s+(?:Ok|Some)\(\s*(?P<target>{_ID})\s*\)\s*=\s*", _PLAIN),
        keyed=(r"(?P<source>[a-z_]\w*)\.(?P<key>[A-Za-z_]\w*)(?![\w(.:])",), imports=(r"use\s+(?P<path>[\w:]+)\s+as\s+(?P<alias>\w+)",),
        exports=(r"pub(?:\([^)]*\))?\s+(?:const|static(?:\s+mut)?)\s+(?P<export>\w+)\s*:[^=;]+=\s*(?P<value>[^;]*)", r"pub(?:\([^)]*\))?\s+(?:(?:async|unsafe|const)\s+)*(?:fn|struct|enum|trait|type)\s+(?P<export>\w+)", r"pub\s+use\s+[\w:]+::(?P<local>\w+)\s+as\s+(?P<export>\w+)", r"pub\s+use\s+(?:[\w:]+::)?(?P<export>\w+)\s*;"),
        extra_bindings=(rf"match\s+(?P<value>(?:std::)?env::var\(\s*{_S}\s*\))\s*\{{\s*Ok\(\s*(?P<target>{_ID})\s*\)",),
    ),
    Language(
        "go", ("go",), ("go",), ("os",), None, ("os",), ('("', "('"), (rf"(?<![\w.])(?P<object>\w+)\.(?:Getenv|LookupEnv|Setenv|Unsetenv)\(\s*{_S}", rf"(?<![\w.])viper\.(?:GetString|GetInt|GetBool|GetFloat64|GetDuration|Get)\(\s*{_S}"),
        (rf"(?P<target>{_ID})(?:\s*,\s*\w+)?\s*:=\s*", rf"(?:var|const)\s+(?P<target>{_ID})(?:\s+[\w.*\[\]]+)?\s*=\s*", rf"(?P<target>{_ID})\s*:\s*", _PLAIN), keyed=(r"(?P<source>[A-Za-z_]\w*)\[\s*[\"'`](?P<key>\w+)[\"'`]\s*\]",), imports=(r"(?m)(?:^[ \t]*import[ \t]+|^[ \t]*)(?:(?P<alias>[\w.]+)[ \t]+)?\"(?P<path>[\w./-]+)\"[ \t]*$",),
        exports=(r"(?m)^(?:var|const)\s+(?P<export>[A-Z]\w*)(?:\s+[\w.*\[\]]+)?\s*=\s*(?P<value>[^\n;]*)", r"(?m)^func\s+(?:\([^)]*\)\s*)?(?P<export>[A-Z]\w*)", r"(?m)^type\s+(?P<export>[A-Z]\w*)"), quotes="\"'`",
    ),
    Language(
        "lua", ("lua",), ("lua",), ("os", "os.getenv"), "os.getenv", ("os",), ('("', "('", ' "', " '"), (rf"(?<![\w.])os\.getenv\(?\s*{_S}",), (rf"(?:local\s+)?(?P<target>{_ID})\s*=(?!=)\s*",), ("--",), ("--[[", "]]"), keyed=(r"(?P<source>[A-Za-z_]\w*)\.(?P<key>[A-Za-z_]\w*)(?![\w(.:])", r"(?P<source>[A-Za-z_]\w*)\[\s*[\"'](?P<key>\w+)[\"']\s*\]"),
        imports=(rf"(?:local\s+)?(?P<alias>{_ID})\s*=\s*require\s*\(?\s*[\"'](?P<path>[^\"']+)[\"']", r"(?<![=\w])\s*require\s*\(?\s*[\"'](?P<path>[^\"']+)[\"']"), exports=(r"(?m)^local\s+(?P<export>\w+)\s*=\s*(?P<value>[^\n]*)", r"(?m)^(?:local\s+)?function\s+(?P<export>\w+)\s*\(", r"(?m)^return\s+(?P<export>\w+)\s*$"), closed_by_end=r"\b(?:function|if|do|repeat)\b|\b(?:end|until)\b",
    ),
    Language(
        "php", ("php", "phtml", "php3", "php4", "php5", "phps"), ("php",), ("$_ENV", "$_SERVER", "getenv", "env"), "$_ENV", (), ('["', "['", '("', "('"), (rf"\$_ENV\[\s*{_S}\s*\]", rf"\$_SERVER\[\s*{_S}\s*\]", rf"(?<![\w:>$])getenv\(\s*{_S}", rf"(?<![\w:>$])env\(\s*{_S}", rf"(?<![\w:>$])config\(\s*{_S}", rf"(?<!\w)(?:Env|Dotenv)::get\(\s*{_S}"),
        (r"(?P<target>\$[A-Za-z_]\w*)\s*=(?![=>])\s*",), ("//", "#"), object_alias=r"\$_(?:ENV|SERVER)", keyed=(r"(?P<source>\$[A-Za-z_]\w*)\[\s*[\"'](?P<key>\w+)[\"']\s*\]",), imports=(r"(?m)^\s*use\s+(?P<path>[\w\\]+)(?:\s+as\s+(?P<alias>\w+))?\s*;", r"(?:require|include)(?:_once)?\s*\(?\s*[\"'](?P<path>[^\"']+)[\"']"),
        exports=(r"(?m)^\s*(?:(?:abstract|final)\s+)?class\s+(?P<export>\w+)", r"(?m)^function\s+(?P<export>\w+)", r"(?m)^\s*(?:public\s+)?const\s+(?P<export>\w+)\s*=\s*(?P<value>[^;]*)"), any_assignment_reassigns=True, identifier=r"\$[A-Za-z_]\w*",
    ),
    Language(
        "ruby", ("rb", "rake", "gemspec", "ru"), ("ruby",), ("ENV",), "ENV", ("dotenv",), ('["', "['", '("', "('"), (rf"(?<!\w)ENV\[\s*{_S}\s*\]", rf"(?<!\w)ENV\.(?:fetch|key\?|has_key\?|include\?)\(\s*{_S}"), (r"(?P<target>[A-Za-z_]\w*)\s*=(?![=~>])\s*",), ("#",), None, "ENV", (r"(?P<source>[a-z_]\w*)\[\s*:(?P<key>\w+)\s*\]", r"(?P<source>[a-z_]\w*)\[\s*[\"'](?P<key>\w+)[\"']\s*\]"),
        (r"(?m)^\s*(?:require|require_relative|load)\s*\(?\s*[\"'](?P<path>[^\"']+)[\"']",), (r"(?m)^\s*(?:class|module)\s+(?P<export>[A-Z]\w*)", r"(?m)^def\s+(?:self\.)?(?P<export>\w+[?!]?)"), any_assignment_reassigns=True, closed_by_end=r"\b(?:def|class|module|begin|case)\b|(?:(?<=\n)|(?<=;)|^)[ \t]*(?:if|unless|while|until|for)\b|\bdo\b|\bend\b", identifier=r"[@$]{0,2}[A-Za-z_]\w*",
    ),
    Language(
        "bash", ("sh", "bash", "zsh", "zshrc", "bashrc", "bash_profile", "zprofile"), ("shellscript", "bash", "sh", "zsh"), (), None, (), ("$", "${"), (r"(?<!\\)\$(?P<name>[A-Za-z_][A-Za-z0-9_]*)", r"(?<!\\)\$\{(?P<name>[A-Za-z_][A-Za-z0-9_]*)(?::?[-=+?][^}]*)?\}"), (r"(?:(?:export|local|readonly|declare)\s+)?(?P<target>[A-Za-z_]\w*)=\"?",), ("#",), None,
        imports=(r"(?m)(?:^|[;&|])\s*(?:source|\.)[ \t]+(?P<path>[^\s;&|]+)",), exports=(r"(?m)^\s*(?:export|declare\s+-x)\s+(?P<export>[A-Za-z_]\w*)(?:=(?P<value>[^\n;]*))?", r"(?m)^(?:function\s+)?(?P<export>[A-Za-z_]\w*)\s*\(\)"), reassigns=r"(?m)(?:^|[;&|({]|\b(?:export|local|readonly|declare)\b)[ \t]*(?P<target>%s)=", any_assignment_reassigns=True, identifier=r"[A-Za-z_]\w*",
    ),
    Language("c", ("c", "h"), ("c",), ("getenv", "secure_getenv"), None, (), ('("', "('"), _GETENV, (rf"(?:(?:const|static)\s+)*(?:char|auto)\s*\**\s*(?:const\s+)?(?P<target>{_ID})\s*=\s*(?:\([\w\s*]+\)\s*)?", _PLAIN), imports=(r"(?m)^\s*#\s*include\s*[<\"](?P<path>[^>\"]+)[>\"]",), exports=(r"(?m)^(?!static\b)(?:[A-Za-z_][\w]*[\s*]+)+(?P<export>\w+)\s*\([^;{]*\)\s*\{", r"(?m)^(?!static\b|return\b|typedef\b)(?:[A-Za-z_]\w*[\s*]+)+(?P<export>\w+)\s*=\s*(?P<value>[^;]*);")),
    Language("cpp", ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), ("cpp", "c++"), ("getenv", "secure_getenv", "std"), None, (), ('("', "('"), (*_GETENV, rf"(?<!\w)std::getenv\(\s*{_S}"), (rf"(?:(?:const|static|constexpr)\s+)*(?:char|auto|std::string|std::string_view)\s*[&*]*\s*(?:const\s+)?(?P<target>{_ID})\s*=\s*(?:\([\w\s*]+\)\s*)?", _PLAIN), imports=(r"(?m)^\s*#\s*include\s*[<\"](?P<path>[^>\"]+)[>\"]", r"using\s+namespace\s+(?P<path>[\w:]+)\s*;"), exports=(r"(?m)^(?!static\b)(?:[A-Za-z_][\w:<>]*[\s*&]+)+(?P<export>\w+)\s*\([^;{]*\)\s*(?:const\s*)?\{", r"(?m)^\s*(?:class|struct)\s+(?P<export>\w+)", r"(?m)^\s*namespace\s+(?P<export>\w+)")),
    Language("java", ("java",), ("java",), ("System",), None, (), ('("', "('"), (rf"(?<!\w)System\.getenv\(\s*{_S}", rf"(?<!\w)System\.getProperty\(\s*{_S}"), (_TYPED, _PLAIN), imports=(r"(?m)^\s*import\s+(?:static\s+)?(?P<path>[\w.]+(?:\.\*)?)\s*;",), exports=(rf"{_PUBLIC}(?:class|interface|enum|record)\s+(?P<export>\w+)", rf"{_PUBLIC}[\w<>\[\], ]+\s+(?P<export>\w+)\s*\(", rf"{_PUBLIC}[\w<>\[\]]+\s+(?P<export>\w+)\s*=\s*(?P<value>[^;]*);")),
    Language("kotlin", ("kt", "kts"), ("kotlin",), ("System",), None, (), ('("', "('"), (rf"(?<!\w)System\.getenv\(\s*{_S}",), (rf"(?:val|var)\s+(?P<target>{_ID})\s*(?::\s*[\w?<>., ]+?)?\s*=\s*", _PLAIN), imports=(r"(?m)^\s*import\s+(?P<path>[\w.]+(?:\.\*)?)",), exports=(r"(?m)^\s*(?:(?:data|open|abstract|sealed|enum)\s+)*(?:class|object|interface)\s+(?P<export>\w+)", r"(?m)^\s*(?:(?:suspend|override|inline)\s+)*fun\s+(?P<export>\w+)", r"(?m)^(?:const\s+)?(?:val|var)\s+(?P<export>\w+)\s*(?::[^=\n]+)?=\s*(?P<value>[^\n]*)")),
    Language("csharp", ("cs", "csx"), ("csharp", "c#"), ("Environment",), None, (), ('("', "('"), (rf"(?<!\w)(?:System\.)?Environment\.GetEnvironmentVariable\(\s*{_S}",), (_TYPED, _PLAIN), imports=(r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?P<path>[\w.]+)\s*;",), exports=(rf"{_PUBLIC}(?:class|interface|struct|record|enum)\s+(?P<export>\w+)", rf"{_PUBLIC}[\w<>\[\]?, ]+\s+(?P<export>\w+)\s*\(", rf"{_PUBLIC}[\w<>\[\]?]+\s+(?P<export>\w+)\s*\{{\s*get", rf"{_PUBLIC}[\w<>\[\]?]+\s+(?P<export>\w+)\s*=\s*(?P<value>[^;]*);")),
    Language("elixir", ("ex", "exs"), ("elixir",), ("System",), None, (), ('("', "('"), (rf"(?<!\w)System\.(?:get_env|fetch_env!?)\(\s*{_S}",), (r"(?P<target>[a-z_]\w*)\s*=(?![=~>])\s*",), ("#",), None, imports=(r"(?m)^\s*(?:alias|import|require|use)\s+(?P<path>[A-Z][\w.]*)",), exports=(r"(?m)^\s*def\s+(?P<export>[a-z_]\w*[?!]?)", r"(?m)^\s*defmodule\s+(?P<export>[A-Z][\w.]*)"), any_assignment_reassigns=True, closed_by_end=r"\b(?:do|fn)\b(?!:)|\bend\b"),
    Language("zig", ("zig",), ("zig",), ("std",), None, (), ('("', "('"), (rf"(?<!\w)std\.(?:os|posix)\.getenv\(\s*{_S}",), (rf"(?:const|var)\s+(?P<target>{_ID})\s*(?::[^=;]+)?=\s*", _PLAIN), block_comment=None, imports=(rf"(?:const|var)\s+(?P<alias>{_ID})\s*=\s*@import\(\s*\"(?P<path>[^\"]+)\"\s*\)",), exports=(r"pub\s+(?:inline\s+|extern\s+)?fn\s+(?P<export>\w+)", r"pub\s+(?:const|var)\s+(?P<export>\w+)\s*(?::[^=;]+)?=\s*(?P<value>[^;]*)"), reassigns=r"(?!)(?P<target>%s)"),
)
BY_EXTENSION = {e: x for x in LANGUAGES for e in x.extensions}
BY_NAME = {x.name: x for x in LANGUAGES}
BY_ID = {i: x for x in LANGUAGES for i in x.ids}
#: Value suffixes that leave a binding what it is: TypeScript's assertions.
END = _END
