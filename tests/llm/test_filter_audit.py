"""The filter audit against plain loops."""

import random
from itertools import permutations

import pytest

from inkspect.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, n int, mask string, part int, quality string"


def rows():
    own = random.Random(8)
    word = lambda: own.choice(["a", "B", "Ccc", "d#", "é", "\x1c", "f"]) + str(own.randrange(90))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(150)
    texts = [None, "", "", " \t\n", base, base, base, base.lower(), text(99), text(100), text(101), "A" * 50, "x " * 300, "#", "1|2", text(4000), "a " * 20_000 + "é"]
    texts += [base] * 40 + [own.choice(["one text", "One text", "#another"]) for _ in range(40)]
    made = [(i, t, own.choice(["en", "fr", None, "", "de"])) for i, t in enumerate(texts)]
    own.shuffle(made)
    return [*made, made[3], made[3], (None, base, "en"), (None, base, "en"), (None, None, None)]


ROWS = rows()
LABELS = [(i, i % 3 and 1, None if i % 5 else 1) for i in range(0, 90, 2)] + [(4, 0, 1), (4, 1, 0), (6, None, None), (None, 1, 1), (999, 1, 1)]


def failing(doc_id, text):
    text, words = text or "", []
    for piece in text.replace("\t", " ").replace("\n", " ").split(" "):
        words += [piece] if piece else []
    out = {"A"} if len(words) < 100 else set()
    out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
    out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
    out |= {"D"} if set(text) & set("#$%&*|") else set()
    same = [i for i, t, _ in ROWS if (t or "") == text and i is not None]
    return out | ({"E"} if doc_id is not None and min(same) < doc_id else set())


def by_hand():
    good, toxic = ({x[0] for x in LABELS if x[0] is not None and x[c] == 1} for c in (1, 2))
    docs = [(part or "", failing(i, t), i in good, i in toxic) for i, t, part in ROWS]
    out = []
    for part in {d[0] for d in docs}:
        mine, steps = [d for d in docs if d[0] == part], []
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                earlier = [d for d in mine if name in d[1] and d[1] & set(order[: step - 1])]
                steps.append((part, "".join(order), step, len(left), len(gone), len(earlier), sum(d[1] == {name} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        total = {name: sum(s[4] for s in steps if s[1][s[2] - 1] == name) for name in "ABCDE"}
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, part, 1, "m", 2, "q") for i, t, part in ROWS], SCHEMA).repartition(5)


def test_audit_equals_plain_loops(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert sorted(tuple(x) for x in filter_audit.audit(docs, labels).collect()) == by_hand()


def masks(docs, **options):
    out = {}
    for x in filter_audit.masks(docs, **options).collect():
        key = (x.doc_id, x.part, x.mask)
        out[key] = out.get(key, 0) + 1
    return out


def test_small_stores_and_colliding_fingerprints_change_nothing(docs):
    expected = {}
    for i, t, part in ROWS:
        key = (i, part or "", sum(1 << "ABCDE".index(x) for x in failing(i, t)))
        expected[key] = expected.get(key, 0) + 1
    assert masks(docs) == masks(docs, store=1) == masks(docs, fingerprint=len) == expected


def test_ids_of_other_types(spark):
    rows = [("b", "same"), ("a", "same"), ("c", "same"), ("d", "other")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "cast(null as string) lang")
    assert sorted(i for i, _, m in masks(docs) if m & 16) == ["b", "c"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, none).collect() == []
    one = spark.createDataFrame([(1, "A text", "en", 1, "m", 2, "q")], SCHEMA)
    assert filter_audit.audit(one, none).where("good_lost + toxic_lost > 0").count() == 0
