"""Circulant MinHash against brute force, and its signatures against plain loops."""

import numpy as np

from inkspect.llm import minhash
from test_near_copies import crowd_corpus, near_corpus


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_hand(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    for i, j in links:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return links, sets, [find(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark):
    texts = near_corpus() + crowd_corpus() + [None, "", "\x0b ", "A b", "a B ", "x " * 30_000 + "y", "x " * 30_000 + "z", "É é", "é é"]
    links, sets, root = by_hand(texts)
    assert len(links) > 300 and 20 < len(set(root)) < len(texts) - 50
    rows = [(i, t, "en", 1, 2, "k", 0.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[7], (None, "a text with a null id", None, 1, 2, "k", None)], "doc_id long, text string, lang string, node int, n int, u string, mark double")
    out = minhash.near_duplicates(docs.repartition(3)).collect()
    expected = [(i, len(sets[i]), r, i == r) for i, r in enumerate(root)]
    assert sorted(tuple(x) for x in out if x.doc_id is not None) == sorted([*expected, expected[7]])
    assert [tuple(x) for x in out if x.doc_id is None] == [(None, 2, None, True)]


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).collect() == []


def test_signature_is_two_permutations_one_of_them_turned():
    own = np.random.default_rng(3)
    h = np.unique(own.integers(0, 1 << 63, 40_000, dtype=np.uint64) * np.uint64(2))
    place = lambda x: minhash.permuted(np.array([x], np.uint32), 0x7FEB352D, 0x846CA68B)[0]
    turned = lambda x, k: minhash.permuted(np.array([(int(x) + k) % 2**32], np.uint32), 0x21F0AAAD, 0xD35A2D97)[0]
    few, cuts = h[:50], [0, 1, 20_000, 20_003, 40_000]
    assert minhash.signatures([few], 7)[0].tolist() == [min(turned(place(int(x) >> 32), k) for x in few) for k in range(7)]
    together = minhash.signatures([h[a:b] for a, b in zip(cuts, cuts[1:])], 5)
    for (a, b), row in zip(zip(cuts, cuts[1:]), together):  # whole sets, or in parts
        assert (row == np.min([minhash.signatures([h[i : min(i + 7000, b)]], 5)[0] for i in range(a, b, 7000)], axis=0)).all()
    assert len(np.unique(minhash.permuted(np.arange(1 << 16, dtype=np.uint32), 0x21F0AAAD, 0xD35A2D97))) == 1 << 16


def test_bands_meet_at_the_threshold():
    own, bands, shared = np.random.default_rng(4), minhash.Bands(50, 6), []
    for n in (20, 100, 1000):
        for _ in range(40):
            a = np.unique(own.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            new = int(n * 0.15 / 1.85)
            b = np.unique(np.concatenate([a[new:], own.integers(0, 1 << 63, new, dtype=np.uint64)]))
            left, right = bands([a, b])
            shared.append(len(np.intersect1d(left[0][2], right[0][2])))
    assert min(shared) >= 2 and np.mean(shared) > 15
    none = np.empty(0, np.uint64)
    assert bands([none]) == [[]] and bands([none, a])[0] == [] and (bands([none, a])[1][0][2] == bands([a])[0][0][2]).all()
