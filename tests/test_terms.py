"""Terms of a dictionary against plain search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspect.operators import terms
from inkspect.operators.registry import RULES
from inkspect.plans.config import Setting, active
from inkspect.plans.linter import lint_slices
from inkspect.sources.plain import plain_slices


def by_hand(texts, pairs):
    out = []
    for i, text in enumerate(texts):
        for p, x in sorted(set(pairs)):
            at = (text or "").find(p) if p and p != x else -1
            while at >= 0:
                if not (x.startswith(p) and text.startswith(x, at)):
                    a = len(text[:at].encode())
                    out.append((i, a, a + len(p.encode()), p, x))
                at = text.find(p, at + len(p))
    return sorted(out)


def corpus(own, alphabet, texts, pairs):
    word = lambda n: "".join(own.choice(alphabet) for _ in range(n))
    return [None, "", *(word(own.randrange(300)) for _ in range(texts)), word(30_000)], [(w := word(own.randrange(1, 9)), own.choice([w + word(1), word(2), w])) for _ in range(pairs)]


@pytest.mark.parametrize("alphabet", ["ab", "abc語é", "こんにちは世界", "a\x00\n𝄞"])
def test_automaton_equals_plain_search(alphabet):
    own = random.Random(alphabet)
    for stretch in (16, 512):
        terms.STRETCH = stretch
        texts, pairs = corpus(own, alphabet, 40, 60)
        data = "".join(t or "" for t in texts).encode()
        offsets = np.cumsum([0, *(len((t or "").encode()) for t in texts)])
        found = []
        for automaton in terms.automata(pairs, 20_000):
            for t, a, k in zip(*(x.tolist() for x in automaton.find(np.frombuffer(data, np.uint8), offsets))):
                found.append((t, a, a + int(automaton.lengths[k]), *automaton.pairs[k]))
        assert sorted(found) == by_hand(texts, pairs)


def test_both_ways_equal_plain_search(spark):
    texts, pairs = corpus(random.Random(3), "abcd語 ", 60, 150)
    pairs += [("", "x"), ("same", "same"), ("abcdabcd", "long"), ("語" * 3, "three")]
    texts += ["abcdabcdabcd" * 5, texts[5], "語" * 10]
    docs = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "doc_id long, text string, pattern string").repartition(3)
    given = spark.createDataFrame([*pairs, (None, "x"), ("ab", None), pairs[0]], "pattern string, expected string")
    expected = by_hand(texts, pairs)
    assert len(expected) > 1000
    assert sorted(tuple(r) for r in terms.find(docs, given, ["doc_id"]).collect()) == expected
    assert sorted(tuple(r) for r in terms.find(docs, given, ["doc_id"], largest=1).collect()) == expected
    assert terms.find_by_join(docs.limit(0), given, ["doc_id"]).count() == terms.find(docs, given.limit(0), ["doc_id"]).count() == 0


def test_many_terms_of_the_rule_are_found_as_few_are(spark):
    own = random.Random(4)
    texts, pairs = corpus(own, "abc語", 30, 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = [*pairs, pairs[0]]  # twice is found twice

    def found(pairs):
        rules = active({"ja-prh": Setting(options={"terms": [{"expected": x, "pattern": p} for p, x in pairs]})}, "ja")
        rows = lint_slices(plain_slices(docs), [r for r in rules if r.id == "ja-prh"]).collect()
        return [(r.doc_id, r.start, r.end, r.message, [tuple(f) for f in r.fixes]) for r in rows]

    one_by_one = [row for pair in pairs for row in found([pair])]
    assert len(one_by_one) > 40 and sorted(found(pairs)) == sorted(one_by_one)
    assert "ja-prh" in RULES


def test_regex_terms_are_ascii_and_count_bytes(spark):
    docs = spark.createDataFrame([(1, "語１2é３ 4a É")], "doc_id long, text string")
    options = {"terms": [{"expected": "N", "regexPatterns": [{"source": "\\d"}]}, {"expected": "E", "regexPatterns": [{"source": "é", "ignoreCase": True}]}]}
    rules = active({"ja-prh": Setting(options=options)}, "ja")
    rows = lint_slices(plain_slices(docs), [r for r in rules if r.id == "ja-prh"]).collect()
    assert sorted((r.start, r.end) for r in rows) == [(6, 7), (7, 9), (13, 14)]


def test_matches_of_a_term_that_do_not_touch_are_not_walked(monkeypatch):
    pairs = [("ab", "x"), ("bc", "y"), ("aba", "z")]
    automaton = terms.Automaton(pairs)
    data = np.frombuffer(b"abc ababa " * 3000, np.uint8)
    walked = []

    class Places(np.ndarray):
        def tolist(self):
            walked.append(len(self))
            return super().tolist()

    plain = np.flatnonzero
    monkeypatch.setattr(terms.np, "flatnonzero", lambda x: plain(x).view(Places))
    _, start, term = automaton.find(data, np.array([0, len(data)]))
    assert len(start) == 3 * 3000 + 3000 + 3000 and sum(walked) == 3000  # of "aba" alone each second one begins in the one before
    assert (start[term == 2] % 10 == 4).all()


def test_texts_meet_terms_in_blocks(spark, monkeypatch):
    texts, pairs = corpus(random.Random(8), "abcd語 ", 60, 150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    given = spark.createDataFrame(pairs, "pattern string, expected string")
    for block, blocks in ((1, 60), (1 << 20, 4)):
        monkeypatch.setattr(terms, "BLOCK", block)
        rows = terms.table(terms._blocks(docs, ["doc_id"], "text"), "blocks")
        sizes = [r.n for r in rows.groupBy("block").agg(F.sum(F.octet_length("text")).alias("n")).collect()]
        assert len(sizes) >= blocks if block == 1 else len(sizes) < blocks
        assert sorted(tuple(r) for r in terms.find_by_join(docs, given, ["doc_id"]).collect()) == by_hand(texts, pairs)
