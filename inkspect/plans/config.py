"""Configuration: JSON, JSONC and YAML; presets; column overlays.  Driver-side only."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from ..operators.registry import RULES, SEVERITIES

#: File names looked for, in order, and presets.
FILE_NAMES = [".inkspect.json", ".inkspect.jsonc", ".inkspect.yaml", ".inkspect.yml", "inkspect.config.json"]
PRESETS = {
    "ja-basic": {"no-hankaku-kana": None, "no-mixed-zenkaku-hankaku-alphabet": None, "no-nfd": None, "no-zero-width-spaces": None, "ja-no-mixed-period": None},
    "ja-technical-writing": {id: None for id in RULES if id not in ("ja-prh", "no-todo")} | {"sentence-length": {"max": 100}, "max-comma": {"max": 3}, "max-ten": {"max": 3}, "max-kanji-continuous-len": {"max": 6}},
}
LIMIT = 1 << 20


class ConfigError(ValueError):
    """kind is one of io, parse, unknown-preset, unknown-format, column-name-without-header, non-ascii-delimiter, morphology-source, invalid-pin, unsupported-language."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass(frozen=True)
class Setting:
    enabled: bool = True
    severity: str | None = None
    options: Any = None


@dataclass(frozen=True)
class Column:
    """A target column: its header name or its number from 1, how its cells are read, and its own rules."""

    selector: str | int
    parse_mode: str = "markdown"
    rules: dict[str, Setting] = field(default_factory=dict)


@dataclass(frozen=True)
class Format:
    header: bool = False
    delimiter: str | None = None
    columns: tuple[Column, ...] = ()


@dataclass(frozen=True)
class Config:
    language: str | None = None
    message_language: str | None = None
    rules: dict[str, Setting] = field(default_factory=dict)
    formats: dict[str, Format] = field(default_factory=dict)
    morphology: dict | None = None

    def lang(self) -> str | None:
        return primary_language(self.language)

    def unknown(self) -> list[str]:
        """Ids in the rules, the columns' rules included, that no rule has."""
        ids = set(self.rules) | {id for f in self.formats.values() for c in f.columns for id in c.rules}
        return sorted(ids - set(RULES))


def primary_language(tag: str | None) -> str | None:
    return re.split("[-_]", tag, maxsplit=1)[0].lower() if tag else None


def _bad(message: str) -> ConfigError:
    return ConfigError("parse", message)


def _object(value: Any, keys: set[str] | None, where: str) -> dict:
    if not isinstance(value, dict):
        raise _bad(f"{where}: an object is expected")
    if keys is not None and (extra := set(value) - keys):
        raise _bad(f"{where}: unknown key {sorted(map(str, extra))[0]!r}")
    return value


def _text(value: Any, where: str) -> str | None:
    if value is not None and not isinstance(value, str):
        raise _bad(f"{where}: a string is expected")
    return value


def _setting(value: Any, where: str) -> Setting:
    if isinstance(value, str) and value.lower() in ("true", "yes", "on", "false", "no", "off"):
        value = value.lower() in ("true", "yes", "on")
    if isinstance(value, bool):
        return Setting(value)
    value = _object(value, {"severity", "options"}, where)
    severity = value.get("severity", "warning")
    if severity not in SEVERITIES:
        raise _bad(f"{where}: unknown severity {severity!r}")
    return Setting(True, value.get("severity"), value.get("options"))


def _rules(value: Any, where: str) -> dict[str, Setting]:
    return {id: _setting(x, f"{where}.{id}") for id, x in _object(value, None, where).items()}


def _format(name: str, value: Any) -> Format:
    if name not in ("csv", "tsv"):
        raise ConfigError("unknown-format", f"unknown format {name!r}")
    where = f"formats.{name}"
    value = _object(value, {"header", "delimiter", "columns"}, where)
    header, delimiter = value.get("header", False), value.get("delimiter")
    if not isinstance(header, bool):
        raise _bad(f"{where}.header: true or false is expected")
    if delimiter is not None:
        if not isinstance(delimiter, str) or len(delimiter) != 1:
            raise _bad(f"{where}.delimiter: one character is expected")
        if not delimiter.isascii():
            raise ConfigError("non-ascii-delimiter", f"{where}.delimiter: {delimiter!r} is not ASCII")
    columns = []
    for key, raw in sorted(_object(value.get("columns", {}), None, f"{where}.columns").items(), key=lambda x: str(x[0])):
        key = str(key)
        raw = _object(raw, {"parse-mode", "rules"}, f"{where}.columns.{key}")
        number = int(key) if re.fullmatch(r"\+?[0-9]+", key) and 1 <= int(key) < 1 << 32 else None
        if number is None and not header:
            raise ConfigError("column-name-without-header", f"{where}: column {key!r} is named, but there is no header")
        mode = raw.get("parse-mode") or "markdown"
        if mode not in ("markdown", "plain"):
            raise _bad(f"{where}.columns.{key}.parse-mode: {mode!r}")
        columns.append(Column(number or key, mode, _rules(raw.get("rules", {}), f"{where}.columns.{key}.rules")))
    return Format(header, delimiter, tuple(columns))


def _morphology(value: Any) -> dict | None:
    if value is None:
        return None
    value = _object(value, {"path", "url", "pin", "lang"}, "morphology")
    if (value.get("path") is None) == (value.get("url") is None):
        raise ConfigError("morphology-source", "morphology: one of path and url is expected")
    pin = value.get("pin")
    if not isinstance(pin, str) or not re.fullmatch("[0-9A-Fa-f]{64}", pin):
        raise ConfigError("invalid-pin", f"morphology.pin: {pin!r} is not 64 hexadecimal digits")
    if primary_language(value.get("lang") or "ja") != "ja":
        raise ConfigError("unsupported-language", f"morphology.lang: {value['lang']!r}")
    return value


def from_dict(raw: Any) -> Config:
    """Strict in keys, lenient in rules' options; presets lie under the file's own rules, later ones over earlier."""
    raw = _object({} if raw is None else raw, {"language", "message-language", "rules", "extends", "formats", "morphology"}, "config")
    extends = raw.get("extends")
    extends = [] if extends is None else [extends] if isinstance(extends, str) else extends
    if not isinstance(extends, list) or not all(isinstance(x, str) for x in extends):
        raise _bad("extends: a preset or a list of presets is expected")
    rules, language = {}, _text(raw.get("language"), "language")
    for preset in extends:
        if preset not in PRESETS:
            raise ConfigError("unknown-preset", f"unknown preset {preset!r}")
        rules |= {id: Setting(True, None, options) for id, options in PRESETS[preset].items()}
        language = language or "ja"
    rules |= _rules(raw.get("rules", {}), "rules")
    formats = {name: _format(name, x) for name, x in _object(raw.get("formats", {}), None, "formats").items()}
    return Config(language, _text(raw.get("message-language"), "message-language"), rules, formats, _morphology(raw.get("morphology")))


def without_comments(text: str) -> str:
    """JSON with comments and trailing commas as plain JSON; strings are left alone."""
    token = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
    text = token.sub(lambda m: m[0] if m[0][0] == '"' else " ", text)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[\]}])', lambda m: m[1] or "", text, flags=re.S)


def _pairs(pairs: list[tuple[str, Any]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise _bad("a key occurs twice")
    return dict(pairs)


def parse(text: str, kind: str) -> Config:
    """kind: json, jsonc or yaml.  Blank text is the default; a byte-order mark is skipped; YAML anchors and aliases are errors."""
    text = text.removeprefix("\ufeff")
    if not text.strip():
        return Config()
    try:
        if kind in ("json", "jsonc"):
            return from_dict(json.loads(without_comments(text) if kind == "jsonc" else text, object_pairs_hook=_pairs))
        import yaml

        if any(isinstance(t, (yaml.AliasToken, yaml.AnchorToken)) for t in yaml.scan(text)):
            raise _bad("anchors and aliases are not allowed")
        return from_dict(yaml.safe_load(text))
    except ConfigError:
        raise
    except Exception as e:
        raise _bad(str(e)) from e


def discover(folder: str) -> tuple[Path | None, list[Path]]:
    """The nearest configuration file at or above ``folder``, and those beside it that it hides."""
    for at in [Path(folder).resolve(), *Path(folder).resolve().parents]:
        if there := [at / name for name in FILE_NAMES if (at / name).is_file()]:
            return there[0], there[1:]
    return None, []


def load(path: str | Path) -> Config:
    path = Path(path)
    try:
        if path.stat().st_size > LIMIT:
            raise ConfigError("io", f"{path} is larger than {LIMIT} bytes")
        text = path.read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise ConfigError("io", str(e)) from e
    return parse(text, {".json": "json", ".jsonc": "jsonc"}.get(path.suffix, "yaml"))


STARTER = """// Settings of rules: false, true, or {"severity": ..., "options": {...}}
{
  "language": "ja",
  "extends": ["ja-technical-writing"],
  "rules": {}
}
"""


def init(folder: str) -> Path:
    """Write a starter file; never over an existing one."""
    path = Path(folder) / FILE_NAMES[1]
    with path.open("x", encoding="utf-8") as f:
        f.write(STARTER)
    return path


@dataclass(frozen=True)
class Active:
    """A rule to run, with its options and severity."""

    id: str
    options: dict
    severity: str


def active(rules: dict[str, Setting], lang: str | None, scoped: bool = True) -> list[Active]:
    """Rules are on unless switched off; those for Japanese alone need a Japanese document, if ``scoped``."""
    out = []
    for rule in RULES.values():
        setting = rules.get(rule.id, Setting())
        if setting.enabled and not (scoped and rule.japanese and lang != "ja"):
            out.append(Active(rule.id, setting.options if isinstance(setting.options, dict) else {}, setting.severity or rule.severity))
    return out


def overlay(base: dict[str, Setting], own: dict[str, Setting]) -> dict[str, Setting]:
    """A column's rules over the base."""
    return base | own


def with_terms(config: Config, terms: list[dict]) -> Config:
    """Dictionary terms go before the rule's own."""
    now = config.rules.get("ja-prh", Setting())
    options = dict(now.options) if isinstance(now.options, dict) else {}
    own = options.get("terms") if isinstance(options.get("terms"), list) else []
    return replace(config, rules=config.rules | {"ja-prh": replace(now, options=options | {"terms": [*terms, *own]})})
