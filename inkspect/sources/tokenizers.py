"""Tokens for token rules: by white space, or by a lattice over a MeCab-style dictionary."""

from __future__ import annotations

import csv
import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import each_of, pieces
from ..operators.tokens import TOKENS
from ..plans.linter import node_texts
from .plain import BLOCK_KINDS

#: Dictionary columns by name; the first three number columns and the surface come before them.
FEATURES = ["pos", "pos1", "pos2", "pos3", "ctype", "cform", "base_form", "reading", "pron"]
JAPANESE, NO_TAGSET, IPADIC = 0, 0, 1


def blocks(slices: DataFrame) -> DataFrame:
    """(doc_id, slice_id, base, node_id, node_start, node_text) of the nodes that token rules visit."""
    own = F.filter("nodes", lambda n: n["kind"].isin(BLOCK_KINDS))
    both = F.explode(F.arrays_zip(own.alias("node"), node_texts(BLOCK_KINDS).alias("piece")))
    rows = slices.select("doc_id", "slice_id", F.col("start").alias("base"), both.alias("x"))
    return rows.select("doc_id", "slice_id", "base", F.col("x.node.node_id").alias("node_id"), F.col("x.piece.start").alias("node_start"), F.col("x.piece.text").alias("node_text"))


def whitespace_tokens(slices: DataFrame) -> DataFrame:
    """Runs without white space, as tokens without features; they count as known."""
    texts = blocks(slices)
    rows = each_of(texts, [c for c in texts.columns if c != "node_text"], pieces(F.col("node_text"), r"(?U:\S)+"))
    none = F.lit(None).cast("string")
    empty = {c: none.alias(c) for c in ("reading", "base_form", "pos", "pos1", "pos2", "pos3", "ctype", "cform", "pron")}
    own = {
        "start": (F.col("start") + F.col("node_start")).alias("start"), "end": (F.col("end") + F.col("node_start")).alias("end"), "surface": F.col("value").alias("surface"), "written": F.col("value").alias("written"),
        "lang": F.lit(JAPANESE).alias("lang"), "tagset": F.lit(NO_TAGSET).alias("tagset"), "is_unknown": F.lit(False).alias("is_unknown"),
    }
    names = [x.split()[0] for x in TOKENS.split(", ")]
    return rows.select(*(own.get(c) if c in own else empty.get(c, F.col(c)) for c in names))


@dataclass
class Dictionary:
    """Entries by surface, connection costs, and entries for unknown words by class of character."""

    entries: dict[str, list[tuple[int, int, int, list[str]]]]
    costs: dict[tuple[int, int], int] = field(default_factory=dict)
    unknown: dict[str, list[tuple[int, int, int, list[str]]]] = field(default_factory=dict)
    longest: int = 1
    fingerprint: str = ""


CLASSES = [("KANJI", re.compile("[々〇一-鿿]+")), ("HIRAGANA", re.compile("[ぁ-ん]+")), ("KATAKANA", re.compile("[ァ-ヶー]+")), ("NUMERIC", re.compile("[0-9０-９]+")), ("ALPHA", re.compile("[A-Za-zＡ-Ｚａ-ｚ]+")), ("SPACE", re.compile(r"\s+")), ("DEFAULT", re.compile(r".", re.S))]


def load_dictionary(folder: str, pin: str | None = None, encoding: str = "utf-8") -> Dictionary:
    """Read *.csv, matrix.def and unk.def of a dictionary; ``pin`` is the SHA-256 over their bytes in order of name."""
    files = sorted(p for p in Path(folder).iterdir() if p.suffix == ".csv" or p.name in ("matrix.def", "unk.def"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()
    if pin and pin.lower() != digest:
        raise ValueError("the dictionary is not the pinned one")
    entries, unknown, costs = defaultdict(list), defaultdict(list), {}
    for p in files:
        with p.open(encoding=encoding, newline="") as f:
            if p.name == "matrix.def":
                next(f)
                costs = {(int(a), int(b)): int(c) for a, b, c in (line.split() for line in f if line.strip())}
                continue
            for row in csv.reader(f):
                (unknown if p.name == "unk.def" else entries)[row[0]].append((int(row[1]), int(row[2]), int(row[3]), row[4:]))
    return Dictionary(dict(entries), costs, dict(unknown), max(map(len, entries), default=1), digest)


def analyse(text: str, dictionary: Dictionary) -> list[tuple[int, int, bool, list[str]]]:
    """(start, end, unknown, features) of the cheapest path, in characters.

    A word's cost and the cost between two words add up.  Where no entry begins, or
    always for a run of one class, unknown words fill in; ties go to the path found
    first.
    """
    ends: list[list[tuple]] = [[] for _ in range(len(text) + 1)]
    ends[0] = [(0, 0, None, None)]  # cost, right id, word, path
    for at in range(len(text)):
        if not ends[at]:
            continue
        words = [(at + n, False, e) for n in range(1, min(dictionary.longest, len(text) - at) + 1) for e in dictionary.entries.get(text[at : at + n], ())]
        name, run = next((name, m) for name, p in CLASSES if (m := p.match(text, at)))
        if not words or name not in ("KANJI", "HIRAGANA", "DEFAULT"):
            kinds = dictionary.unknown.get(name) or dictionary.unknown.get("DEFAULT") or [(0, 0, 10_000, [])]
            words += [(run.end(), True, e) for e in kinds]
        for end, unknown, (left, right, cost, features) in words:
            before = min(ends[at], key=lambda x: x[0] + dictionary.costs.get((x[1], left), 0))
            total = before[0] + dictionary.costs.get((before[1], left), 0) + cost
            ends[end].append((total, right, (at, end, unknown, features), before))
    best, out = min(ends[-1], key=lambda x: x[0] + dictionary.costs.get((x[1], 0), 0)), []
    while best[2]:
        out.append(best[2])
        best = best[3]
    return out[::-1]


def lattice_tokens(slices: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Tokens of all blocks by the lattice; white space gives none.  The dictionary is broadcast: its size is that of its files."""
    shared = slices.sparkSession.sparkContext.broadcast(dictionary)
    fields = [x.split() for x in TOKENS.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches):
        words = shared.value
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text, at, place = r["node_text"] or "", 0, r["node_start"]
                own = {k: r[k] for k in ("doc_id", "slice_id", "node_id", "base")}
                for a, b, unknown, features in analyse(text, words):
                    size = len(text[a:b].encode())
                    if text[a:b].strip():
                        f = dict(zip(FEATURES, (None if x == "*" else x for x in features)))
                        rows.append(own | {"gap": text[at:a], "written": text[a:b], "start": place, "end": place + size, "surface": text[a:b], "lang": JAPANESE, "tagset": IPADIC, "is_unknown": unknown} | {k: f.get(k) for k in FEATURES})
                        at = b
                    place += size
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])

    return blocks(slices).mapInArrow(run, TOKENS)


#: By language: slices -> tokens, and what tells one provider's tokens from another's.  The last one registered for a language counts.
PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {}
FINGERPRINTS: dict[str, str] = {}


def register_provider(language: str, analyse: Callable[[DataFrame], DataFrame], version: str | None = None) -> None:
    """Tokens of slices in this language come from ``analyse``; see TOKENS for their columns.

    Kept results count for a provider of the same ``version``; one without is like no other, so
    that what an earlier one or an earlier process has left is not taken for its own.
    """
    PROVIDERS[language] = analyse
    FINGERPRINTS[language] = version or uuid.uuid4().hex


def register_dictionary(folder: str, pin: str | None = None, language: str = "ja") -> Dictionary:
    """Tokens in this language come from the lattice over a dictionary."""
    own = load_dictionary(folder, pin)
    register_provider(language, lambda slices: lattice_tokens(slices, own), own.fingerprint)
    return own


def fingerprint(language: str | None) -> str | None:
    """What kept results of token rules depend on besides text and settings."""
    return FINGERPRINTS.get(language)


def tokens_for(slices: DataFrame, *languages: str | None) -> DataFrame | None:
    """Tokens of the providers that these languages have, one table; None where there is no provider."""
    out = None
    for provider in [PROVIDERS[x] for x in dict.fromkeys(languages) if x in PROVIDERS]:
        found = provider(slices).select([x.split()[0] for x in TOKENS.split(", ")])
        out = found if out is None else out.unionByName(found)
    return out
