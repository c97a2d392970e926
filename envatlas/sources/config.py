"""The configuration: defaults, overlaid by the options a session starts with and then by the workspace's TOML file."""

from __future__ import annotations

import copy
import tomllib
from datetime import date, time
from pathlib import Path

FILE = "envatlas.toml"
SOURCES = ("Shell", "File", "Remote")
#: Precedence that a configuration has if nobody chose one; it then follows the sources that are on by default.
UNCHOSEN = ["Shell", "File"]
# Defaults of the options.
DEFAULTS: dict = {
    "features": {"hover": True, "completion": True, "diagnostics": True, "definition": True, "inlay_hints": False},
    "strict": {"hover": True, "completion": True},
    "inlay_hints": {"direct_references": True, "binding_declarations": True, "binding_usages": False, "property_accesses": True, "max_value_length": 30, "max_hints_per_line": 0},
    "workspace": {"env_files": [".env", ".env.local", ".env.*"], "root": None},
    "resolution": {"precedence": ["Shell", "File"]},
    "interpolation": {"enabled": True, "max_depth": 10},
    "cache": {"enabled": True, "hot_size": 100, "ttl_seconds": 300},
    "sources": {"defaults": {"shell": True, "file": True, "remote": False}},
    "providers": {},
}


def merged(base, overlay):
    """`base` with `overlay` laid over it, tables key by key; a null in the overlay changes nothing."""
    if isinstance(base, dict) and isinstance(overlay, dict):
        out = dict(base)
        for key, value in overlay.items():
            if value is not None:
                out[key] = merged(base[key], value) if key in base else copy.deepcopy(value)
        return out
    return copy.deepcopy(base if overlay is None else overlay)


def plain(value):
    """A TOML value as JSON has it: dates as text."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value.isoformat() if isinstance(value, date | time) else value


def load(root: str | Path | None = None, options: dict | None = None, file: str = FILE) -> dict:
    """Defaults, then options, then the file, where the root has one. A file that can't be parsed is a ValueError."""
    out = merged(copy.deepcopy(DEFAULTS), options)
    path = Path(root) / file if root else None
    if path and path.exists():
        try:
            out = merged(out, plain(tomllib.loads(path.read_text(encoding="utf-8"))))
        except tomllib.TOMLDecodeError as e:
            raise ValueError(f"Failed to parse config: {e}") from e
    if out["resolution"]["precedence"] == UNCHOSEN:
        on = out["sources"]["defaults"]
        out["resolution"]["precedence"] = [s for s in SOURCES if on.get(s.lower())]
    return out


def parsed_precedence(names: list[str]) -> list[str]:
    """Sources by name, case aside; an empty list turns all of them off. An unknown name is a ValueError."""
    known = {s.lower(): s for s in SOURCES}
    for name in names:
        if name.lower() not in known:
            raise ValueError(f"Unknown source: {name}. Valid sources: {', '.join(SOURCES)}")
    return [known[n.lower()] for n in names]


def shown_kinds(hints: dict) -> tuple[str, ...]:
    """The kinds of locations that hints are shown for."""
    switches = (("DirectReference", "direct_references"), ("BindingDeclaration", "binding_declarations"), ("BindingUsage", "binding_usages"), ("PropertyAccess", "property_accesses"))
    return tuple(kind for kind, key in switches if hints.get(key))
