"""The plan builder: slices and settings in, diagnostics out.

All rules on text, blocks and documents become one array expression over a slice,
unpacked once: one scan, no shuffle, the same on a stream.  Token rules are added
only if one is active and tokens are there; regex terms, which need Python, only
if there are any.  What is not active is not in the plan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FIX, bound, each_of
from ..operators import surface
from ..operators.registry import BLOCK, DOCUMENT, RULES, TEXT, TOKENS
from ..operators.tokens import token_hits
from ..sources.plain import BLOCK_KINDS, KIND
from .config import Active, Config, active, overlay

FOUND = f"struct<rule_id:string,severity:string,start:int,end:int,message:string,fixes:array<{FIX}>>"
DIAGNOSTIC = ["doc_id", "slice_id", "rule_id", "severity", "message", "start", "end", "fixes"]


def _tagged(found: Column, rule: Active, by: Column | None = None) -> Column:
    """Hits as findings of a rule, moved by the place of their node; where that is 0, as it is in plain text, nothing is added."""

    def tag(at: Column | None) -> Column:
        place = lambda c: c if at is None else c + at
        fixes = lambda h: h["fixes"] if at is None else F.transform(h["fixes"], lambda f: F.struct(place(f["start"]).alias("start"), place(f["end"]).alias("end"), f["replacement"].alias("replacement")))
        return F.transform(found, lambda h: F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), place(h["start"]).alias("start"), place(h["end"]).alias("end"), h["message"].alias("message"), fixes(h).alias("fixes")))

    return tag(None) if by is None else F.when(by == 0, tag(None)).otherwise(tag(by))


def node_texts(kinds: Iterable[int]) -> Column:
    """array<struct<start,text>> of a slice's nodes of these kinds; a node over the whole slice takes its text as it is, others are cut from bytes that are made once."""
    text = F.col("text")
    own = F.filter(F.col("nodes"), lambda n: n["kind"].isin(list(kinds)))
    part = lambda n, text: F.struct(n["start"].alias("start"), text.alias("text"))
    cut = lambda raw: F.transform(own, lambda n: part(n, F.decode(F.substring(raw, n["start"] + 1, n["end"] - n["start"]), "UTF-8")))
    whole = F.forall(own, lambda n: (n["start"] == 0) & (n["end"] == F.octet_length(text)))
    return F.when(whole, F.transform(own, lambda n: part(n, text))).otherwise(bound(F.encode(text, "UTF-8"), cut))


def _of_nodes(kinds: Iterable[int], rules: list[Active]) -> Column:
    each = lambda n: F.concat(*(_tagged(RULES[r.id].run(n["text"], r.options), r, n["start"]) for r in rules))
    return F.flatten(F.transform(node_texts(kinds), each))


def _of_document(rule: Active) -> Column:
    possible, candidates, decide = RULES[rule.id].run
    moved = lambda n: F.transform(candidates(n["text"], rule.options), lambda m: F.struct((m["start"] + n["start"]).alias("start"), (m["end"] + n["start"]).alias("end"), m["value"].alias("value")))
    found = bound(F.flatten(F.transform(node_texts([KIND["text"]]), moved)), lambda found: decide(found, rule.options))
    return F.when(possible(F.col("text")), _tagged(found, rule)).otherwise(F.array().cast(f"array<{FOUND}>"))


def _scopes(rules: list[Active]) -> dict[str, list[Active]]:
    return {scope: [r for r in rules if RULES[r.id].scope == scope] for scope in (TEXT, BLOCK, DOCUMENT, TOKENS)}


def found_in_slice(rules: list[Active]) -> Column:
    """array<FOUND> of a slice: all rules that see text."""
    by_scope = _scopes(rules)
    parts = [_of_nodes(kinds, by_scope[scope]) for scope, kinds in ((TEXT, [KIND["text"]]), (BLOCK, BLOCK_KINDS)) if by_scope[scope]]
    parts += [_of_document(r) for r in by_scope[DOCUMENT]]
    return F.concat(F.array().cast(f"array<{FOUND}>"), *parts)


def lint_slices(slices: DataFrame, rules: list[Active], tokens: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """(doc_id, slice_id, rule_id, severity, message, start, end, fixes); offsets are bytes of the document.

    A multiset: equal findings are not merged.  In no order; see ``ordered``.
    dealt: see ``token_hits``.
    """
    return _lint_sets(slices, [(None, rules)], tokens, dealt)


def _lint_sets(slices: DataFrame, sets: list[tuple[Column | None, list[Active]]], tokens: DataFrame | None, dealt: bool = False) -> DataFrame:
    """Slices under the first set of rules whose condition holds, in one pass; a set without one takes what is left."""
    out, found = [], F.array().cast(f"array<{FOUND}>")
    for test, rules in reversed(sets):
        found = found_in_slice(rules) if test is None else F.when(test, found_in_slice(rules)).otherwise(found)
    if any(RULES[r.id].scope != TOKENS for _, rules in sets for r in rules):
        out.append(each_of(slices.withColumn("base", F.col("start")), ["doc_id", "slice_id", "base"], found))
    earlier = F.lit(False)
    for test, rules in sets:
        own = slices.where(~earlier if test is None else test & ~earlier) if len(sets) > 1 else slices
        earlier = earlier if test is None else earlier | test
        out += _beside(own, _scopes(rules), tokens, len(sets) > 1, dealt)
    if not out:
        out = [slices.where(F.lit(False)).select("doc_id", "slice_id", F.col("start").alias("base"), F.inline(F.array().cast(f"array<{FOUND}>")))]
    together = out[0]
    for more in out[1:]:
        together = together.unionByName(more)
    base = F.col("base")
    fixes = F.transform("fixes", lambda f: F.struct((f["start"] + base).alias("start"), (f["end"] + base).alias("end"), f["replacement"].alias("replacement")))
    return together.select("doc_id", "slice_id", "rule_id", "severity", "message", (F.col("start") + base).alias("start"), (F.col("end") + base).alias("end"), fixes.alias("fixes"))


def _beside(slices: DataFrame, by_scope: dict[str, list[Active]], tokens: DataFrame | None, some: bool, dealt: bool) -> list[DataFrame]:
    """What is not one expression over a slice: terms that are many or given as regex, and rules on tokens (of ``some`` of the slices)."""
    out = []
    for rule in by_scope[TEXT]:
        for find in surface.terms_beside(F.col("node.text"), rule.options) if rule.id == "ja-prh" else []:
            node = slices.select("doc_id", "slice_id", F.col("start").alias("base"), F.explode(node_texts([KIND["text"]])).alias("node"))
            hit = node.select("doc_id", "slice_id", "base", F.col("node.start").alias("at"), find.alias("hit"))
            out.append(each_of(hit, ["doc_id", "slice_id", "base"], _tagged(F.col("hit"), rule, F.col("at"))))
    if tokens is not None and by_scope[TOKENS]:
        if some:
            own = slices.select(F.col("doc_id").alias("d"), F.col("slice_id").alias("s"))
            tokens = tokens.join(own, tokens.doc_id.eqNullSafe(F.col("d")) & (tokens.slice_id == F.col("s")), "left_semi")
        out.append(token_hits(tokens, by_scope[TOKENS], {r.id: RULES[r.id].run for r in by_scope[TOKENS]}, dealt and not some))
    return out


def lint(slices: DataFrame, config: Config | None = None, format: str | None = None, tokens: DataFrame | None = None, scoped: bool = True) -> DataFrame:
    """Lint slices under a configuration; slices of a delimited format take their column's rules over the base.

    A column is found by its name first, then by its number.
    """
    config = config or Config()
    columns = config.formats[format].columns if format in config.formats else ()
    base = active(config.rules, config.lang(), scoped)
    if not columns:
        return lint_slices(slices, base, tokens)
    named = [c for c in columns if isinstance(c.selector, str)] + [c for c in columns if not isinstance(c.selector, str)]
    sets = []
    for c in named:
        test = F.trim("column_name") == c.selector if isinstance(c.selector, str) else F.col("column_index") == c.selector
        sets.append((F.coalesce(test, F.lit(False)), active(overlay(config.rules, c.rules), config.lang(), scoped)))
    return _lint_sets(slices, [*sets, (None, base)], tokens)


def ordered(diagnostics: DataFrame) -> DataFrame:
    """The total order of reports."""
    return diagnostics.orderBy("doc_id", "start", "end", "rule_id", "message")


def rule_table(spark, config: Config | None = None) -> DataFrame:
    """(position, rule_id, scope, japanese, severity, enabled, summary) of all rules."""
    config = config or Config()
    rows = []
    for i, r in enumerate(RULES.values()):
        s = config.rules.get(r.id)
        rows.append((i, r.id, r.scope, r.japanese, (s.severity if s else None) or r.severity, s.enabled if s else True, r.summary))
    return spark.createDataFrame(rows, "position int, rule_id string, scope string, japanese boolean, severity string, enabled boolean, summary string")


def notes(config: Config, lang_rules: list[Active] | None = None) -> list[str]:
    """What a user should know: unknown rules, and settings that run nothing."""
    out = [f"unknown rule {id!r}" for id in config.unknown()]
    if not (lang_rules if lang_rules is not None else active(config.rules, config.lang())):
        out.append("no rule is active")
    return out
