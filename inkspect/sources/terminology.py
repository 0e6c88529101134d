"""Terminology dictionaries: YAML with version, imports and rules, as terms of the term rule."""

from __future__ import annotations

import re
from pathlib import Path

DEEPEST = 16


def pattern(text: str) -> tuple[str, dict] | str:
    """A literal, or for /source/flags a regex; of the flags only i and m count, and a slash form without source is literal."""
    m = re.fullmatch(r"/(.+)/([dgimsuvy]*)", text, re.S)
    return ("regex", {"source": m[1], "ignoreCase": "i" in m[2], "multiline": "m" in m[2]}) if m else text


def terms(raw: dict | None) -> list[dict]:
    """Rules with an expected form; specs and options are left aside."""
    out = []
    for rule in (raw or {}).get("rules") or []:
        if not isinstance(rule, dict) or not isinstance(rule.get("expected"), str):
            continue
        given = [x for key in ("pattern", "patterns") for x in (rule.get(key) if isinstance(rule.get(key), list) else [rule.get(key)]) if isinstance(x, str)]
        found = [pattern(x) for x in given]
        out.append({"expected": rule["expected"], "patterns": [x for x in found if isinstance(x, str)], "regexPatterns": [x[1] for x in found if not isinstance(x, str)]})
    return out


def load(path: str | Path, seen: frozenset[Path] = frozenset()) -> list[dict]:
    """Terms of a dictionary, its imports first; a file that imports itself is read once, and imports end at a depth of 16."""
    import yaml

    path = Path(path).resolve()
    if path in seen or len(seen) >= DEEPEST:
        return []
    raw = yaml.safe_load(path.read_text(encoding="utf-8").removeprefix("\ufeff")) or {}
    out = []
    for name in raw.get("imports") or []:
        name = name.get("path") if isinstance(name, dict) else name
        if isinstance(name, str):
            out += load(path.parent / name, seen | {path})
    return out + terms(raw)
