"""All rules in registry order, and how each is run."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from . import surface, tokens

TEXT, BLOCK, DOCUMENT, TOKENS = "text", "block", "document", "tokens"
SEVERITIES = ["error", "warning", "info", "hint"]


@dataclass(frozen=True)
class Rule:
    """A rule: where it looks, whether it is for Japanese alone, and its function.

    text and block: run(text, options) gives hits of a node; document: a test of
    the slice, candidates and decision; tokens: run(work, rule) adds to the windows.
    Fixing runs only the rules that may have fixes.
    """

    id: str
    scope: str
    japanese: bool
    run: Any
    summary: str
    severity: str = "warning"
    fixes: bool = True


def _rules() -> dict[str, Rule]:
    s, t = surface, tokens
    rows = [
        ("sentence-length", BLOCK, True, s.sentence_length, "sentences that are too long"),
        ("max-ten", BLOCK, True, s.max_ten, "too many 、 in a sentence"),
        ("max-kanji-continuous-len", TEXT, False, s.max_kanji_continuous_len, "long runs of kanji"),
        ("no-hankaku-kana", TEXT, True, s.no_hankaku_kana, "half-width kana"),
        ("no-mixed-zenkaku-hankaku-alphabet", DOCUMENT, False, (s.alphabet_possible, s.alphabet_candidates, s.alphabet_decision), "half-width and full-width letters in one document"),
        ("no-nfd", TEXT, False, s.no_nfd, "combining marks"),
        ("no-zero-width-spaces", TEXT, False, s.no_zero_width_spaces, "invisible code points"),
        ("no-exclamation-question-mark", TEXT, False, s.no_exclamation_question_mark, "exclamation and question marks"),
        ("ja-no-mixed-period", DOCUMENT, True, (s.period_possible, s.period_candidates, s.period_decision), "two kinds of full stop in one document"),
        ("no-todo", TEXT, False, s.no_todo, "markers of unfinished work"),
        ("ja-prh", TEXT, True, s.ja_prh, "terms to be spelled one way"),
        ("max-comma", BLOCK, True, s.max_comma, "too many commas in a sentence"),
        ("no-invalid-control-character", TEXT, False, s.no_invalid_control_character, "control characters"),
        ("no-unmatched-pair", TEXT, True, s.no_unmatched_pair, "brackets without partner"),
        ("ja-unnatural-alphabet", BLOCK, True, s.ja_unnatural_alphabet, "stray letters"),
        ("arabic-kanji-numbers", BLOCK, True, s.arabic_kanji_numbers, "numerals of the wrong kind"),
        ("ja-no-weak-phrase", BLOCK, True, s.ja_no_weak_phrase, "weak phrases"),
        ("ja-no-abusage", BLOCK, True, s.ja_no_abusage, "misused phrases"),
        ("no-doubled-joshi", TOKENS, True, t.no_doubled_joshi, "a particle twice in a sentence"),
        ("no-mix-dearu-desumasu", TOKENS, True, t.no_mix_dearu_desumasu, "plain and polite style in one document"),
        ("no-doubled-conjunctive-particle-ga", TOKENS, True, t.no_doubled_conjunctive_particle_ga, "が twice in a sentence"),
        ("ja-no-redundant-expression", TOKENS, True, t.ja_no_redundant_expression, "ことができる"),
        ("no-dropping-the-ra", TOKENS, True, t.no_dropping_the_ra, "dropped ら"),
        ("no-double-negative-ja", TOKENS, True, t.no_double_negative_ja, "double negatives"),
        ("no-doubled-conjunction", TOKENS, True, t.no_doubled_conjunction, "sentences that begin alike"),
        ("ja-no-successive-word", TOKENS, True, t.ja_no_successive_word, "a word twice in a row"),
    ]
    return {r[0]: Rule(*r, fixes=r[0] == "ja-prh") for r in rows}


RULES = _rules()


def register(rule: Rule) -> None:
    """Add a rule, or replace the one of its id; it is on by default and run like the others of its scope."""
    if rule.scope not in (TEXT, BLOCK, DOCUMENT, TOKENS):
        raise ValueError(f"unknown scope {rule.scope!r}")
    RULES[rule.id] = rule
