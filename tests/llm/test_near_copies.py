"""Near copies against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from inkspect.llm import near_copies, simhash


def near_corpus():
    own = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "a b c", "A b  c", "a b d", *["only one text"] * 2]
    common = [own.choice(vocabulary) for _ in range(30)]
    for n in (9, 14, 40, 120, 400):
        for _ in range(6):
            base = [own.choice(vocabulary) for _ in range(n)] + common
            texts.append(" ".join(base))
            for edits in (1, 1, 2, 3, 5):
                words = list(base)
                for _ in range(max(1, edits * n // 120)):
                    words[own.randrange(len(words))] = own.choice(vocabulary)
                texts.append(" ".join(words))
            for tail in (5, 8, 11, n // 5):
                texts.append(" ".join(base + [own.choice(vocabulary) for _ in range(tail)]))
    own.shuffle(texts)
    return texts


def linked_by_hand(texts):
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1) >= 0.8]
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return pairs, root


def crowd_corpus():
    """One crowd of copies of a text, of more and fewer edits, some of them copies of copies."""
    own = random.Random(12)
    base = [f"b{i}" for i in range(120)]
    made = [base]
    for _ in range(260):
        words = list(own.choice(made) if own.random() < 0.3 else base)
        for _ in range(own.randrange(8)):
            at = own.randrange(len(words))
            words[at : at + own.randrange(3)] = [own.choice(["x", "y", f"z{own.randrange(50)}"])] * own.randrange(2)
        made.append(words)
    return [" ".join(words) for words in made]


@pytest.mark.parametrize("corpus", ["near", "crowd"])
def test_near_copies_equal_brute_force(spark, corpus):
    texts = near_corpus() if corpus == "near" else crowd_corpus()
    pairs, root = linked_by_hand(texts)
    assert len(pairs) > 200 and 20 < len(set(root)) < len(texts) - 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = near_copies.near_copies(docs, 5).collect()
    assert sorted((x.doc_id, x.component_id) for x in out) == list(enumerate(root))


def test_pipeline_stage_links_at_four_fifths(spark, tmp_path):
    texts = near_corpus()
    pairs, root = linked_by_hand(texts)
    bits = [bin((simhash.fingerprint(texts[i] or "", 5) ^ simhash.fingerprint(texts[j] or "", 5)) & (2**64 - 1)).count("1") for i, j in pairs]
    assert sum(b > 3 for b in bits) > 20
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    out = corpus_pipeline.near_copies(spark, docs, str(tmp_path))
    assert out.schema == docs.schema
    assert sorted(x.doc_id for x in out.collect()) == sorted(set(root))


def test_similar_sets_share_as_many_segments_as_they_need():
    own = np.random.default_rng(5)
    met = 0
    for n in [*range(4, 60), 84, 120, 135, 300, 1000]:
        for _ in range(6):
            a = np.unique(own.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            gone, new = own.integers(0, max(1, n // 8) + 1), own.integers(0, max(1, n // 8) + 1)
            b = np.unique(np.concatenate([a[gone:], own.integers(0, 1 << 63, new, dtype=np.uint64)]))
            if near_copies.similar(a, b) and len(b) > 3:
                left, right = ({tag: (need, set(keys.tolist())) for tag, need, keys in near_copies.segments(x)} for x in (a, b))
                common = {tag: len(left[tag][1] & right[tag][1]) for tag in left.keys() & right.keys()}
                assert any(shared >= 2 for shared in common.values())
                assert all(shared >= max(left[tag][0], right[tag][0]) or min(left[tag][0], right[tag][0]) == 1 for tag, shared in common.items())
                met += 1
    assert met > 100


def test_one_row_of_each_component_stays(spark):
    near = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(3, near, "a"), (1, near + " ", "b"), (1, near + " ", "b"), (1, "quite another text of the same id here", "c"), (None, "", "d"), (None, None, "d"), (7, "alone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    kept = near_copies.keep_one(docs)
    assert kept.schema == docs.schema
    out = kept.collect()
    assert sorted((x.doc_id or 0, x.mark or "-") for x in out)[1:] == [(1, "b"), (1, "c"), (7, "-")] and out.count(out[0]) == 1 and len(out) == 4
    assert near_copies.keep_one(docs.limit(0)).count() == 0
