"""Collocations against plain counts."""

import random
import re
from collections import Counter

import numpy as np

from inkspect.llm import collocations
from inkspect.llm.blocks import unpack

SCHEMA = "doc_id long, text string, lang string, n int, rank string, part int, phrase string"


def rows():
    own = random.Random(9)
    some = ["New", "york", "city", "Of", "the", "é", "a", "\x00", "日本", "x-y", "\x85", "b", "the", "a"]

    def text(n):
        out = []
        for _ in range(n):
            out.append("new York city" if own.random() < 0.1 else "rare pair" if own.random() < 0.02 else own.choice(some))
            out.append(own.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", "!?", "\r\n"] if own.random() < 0.3 else " "))
        return "".join(out)

    texts = [None, "", " \t.,", "a " * 500, "the the the the " * 20, text(4000)] + [text(own.randrange(60)) for _ in range(150)]
    made = [(i, t, own.choice(["en", "en", "fr", None])) for i, t in enumerate(texts)]
    return [*made, made[7], (None, "null id of the new york city", "en")]


ROWS = rows()


def by_hand(most=3, least=10, top=2000):
    counts = {}
    for _, text, lang in ROWS:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, most + 1):
                counts.setdefault(lang or "und", Counter()).update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        total = sum(v for k, v in f.items() if " " not in k)
        found = []
        for phrase, a in f.items():
            words = phrase.split(" ")
            if len(words) < 2 or a < least:
                continue
            around = [b for other, b in f.items() if b >= least and f" {phrase} " in f" {other} " and other != phrase]
            if any(100 * b >= 50 * a for b in around):
                continue
            cuts = [(1_000_000 * a * a // (f[" ".join(words[:k])] * f[" ".join(words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found.append((-score, -a, phrase.encode(), f[" ".join(words[:k])], f[" ".join(words[k:])]))
        out += [(lang, rank, p.decode(), -a, left, right, total, -score) for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def frame(spark):
    return spark.createDataFrame([(i, t, lang, 1, "r", 2, "p") for i, t, lang in ROWS], SCHEMA).repartition(3)


def test_collocations_equal_plain_counts(spark):
    expected = by_hand()
    assert len(expected) > 60 and {x[0] for x in expected} == {"en", "fr", "und"}
    out = collocations.collocations(frame(spark), shard_bytes=2000).collect()
    assert sorted(tuple(x) for x in out) == expected


def test_longer_phrases_and_few_ranks(spark):
    out = collocations.collocations(frame(spark), most=4, least=25, top=9).collect()
    assert sorted(tuple(x) for x in out) == by_hand(4, 25, 9)


def test_an_empty_table(spark):
    for rows in ([], [(1, None, "en", 1, "r", 2, "p"), (2, " ., ", None, 1, "r", 2, "p")]):
        assert collocations.collocations(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_automata_count_overlapping_matches():
    text = collocations.plain("a a a b. A a\tb\nb").decode()
    assert text == "a a a b \n a a b \n b \n"
    assert collocations.matches(text, ["a a", "a", "b", "a a b", "b b", "a b \n"]).tolist() == [3, 5, 3, 2, 0, 2]


def test_bounds_are_never_under_the_counts():
    own = random.Random(4)
    texts = ["\n ".join(" ".join(own.choice("abcdefgh") for _ in range(own.randrange(1, 9))) + " " for _ in range(300)) + "\n" for _ in range(4)]
    shards = [collocations.Phrases("en", t, 3) for t in texts]
    sketch = collocations.Sketch(9, 3, 10)  # far too narrow: cells are shared
    asked = [(s, *sketch.cells_of(np.concatenate(s.hashes))) for s in shards]
    bound = Counter()
    for s, cells, order, first in asked:
        counts = np.add.reduceat(np.concatenate(s.counts)[order], first)
        bound.update(dict(zip(cells.tolist(), counts.tolist())))
    named = lambda s, left: {t for n, of in enumerate(left, 1) for t in s.texts(n, of)}
    total = Counter()
    for s in shards:
        for n in (1, 2, 3):
            total.update(dict(zip(s.texts(n, np.arange(len(s.keys[n - 1]))), s.counts[n - 1].tolist())))
    for s, cells, _, _ in asked:
        replies = {b: np.packbits([bound[c] >= 10 for c in cells[x:y].tolist()]).tobytes() for b, x, y in sketch.by_bucket(cells)}
        every = named(s, [np.arange(len(k)) for k in s.keys])
        assert {t for t in every if total[t] >= 10} <= named(s, sketch.left(s, replies))
    assert unpack(collocations.pack([np.array([1, 2], "<u4"), np.array([3, 4], "<u1")]), ["<u4", "<u1"])[1].tolist() == [3, 4]
