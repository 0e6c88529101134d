"""The fixpoint node by node against the one over whole documents."""

import random

import pytest
from pyspark.sql import functions as F

from inkspect.operators.fixes import fix, fixed
from inkspect.operators.incremental import edited, fix_incremental, moved
from inkspect.plans.config import Setting, active
from inkspect.plans.linter import lint_slices
from inkspect.plans.store import table
from inkspect.sources.markdown import markdown_slices
from inkspect.sources.plain import line_slices

FIX = "array<struct<start:int,end:int,replacement:string>>"


def rules(*terms):
    return [r for r in active({"ja-prh": Setting(options={"terms": [{"expected": x, "pattern": p} for p, x in terms]})}, "ja") if r.id == "ja-prh"]


def test_edits_equal_the_fold(spark):
    own, rows = random.Random(6), []
    for i in range(150):
        text = "".join(own.choice("abé語𝄞") for _ in range(own.randrange(20)))
        n = len(text.encode()) + 3
        rows.append((i, text, [(own.randrange(n), own.randrange(n), own.choice(["", "x", "語"])) for _ in range(own.randrange(9))]))
    out = spark.createDataFrame(rows, f"doc_id long, text string, fixes {FIX}").select("doc_id", fixed(F.col("text"), F.col("fixes")).alias("r")).collect()
    by_hand = {i: edited(text.encode(), fixes) for i, text, fixes in rows}
    assert {x.doc_id: (x.r.text, x.r.applied, x.r.deferred) for x in out} == {i: (new.decode(), a, d) for i, (new, _, a, d) in by_hand.items()}
    for i, text, _ in rows:
        new, pieces, _, _ = by_hand[i]
        assert all(text.encode()[a:b] == new[a + s : b + s] for a, b, s in pieces)


def test_untouched_nodes_move():
    data = b"one two three four"
    node = lambda a, b: {"start": a, "end": b, "fixes": [{"start": a, "end": b, "replacement": "z"}]}
    _, pieces, _, _ = edited(data, [(4, 7, "twofold"), (13, 13, "! ")])
    assert [(n["start"], n["end"], n["fixes"][0]["end"]) for n in moved([node(0, 3), node(4, 7), node(8, 12), node(8, 13), node(14, 18), node(0, 18)], pieces)] == [(0, 3, 3), (12, 16, 16), (20, 24, 24)]


def corpus():
    own, rows = random.Random(7), []
    for i in range(30):
        blocks = ["".join(own.choice(["aae", "er", "b ", "a", "é", "語", "*er*"]) for _ in range(own.randrange(12))) for _ in range(own.randrange(15))]
        rows.append((i, own.choice(["\n", "\n\n", "\n\n- "]).join(blocks)))
    return [*rows, (98, None), (99, ""), (None, "er\n\naae")]


@pytest.mark.parametrize("slices", [line_slices, lambda docs: markdown_slices(docs)[0]], ids=["lines", "markdown"])
def test_incremental_equals_whole(spark, slices):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(2)
    own = rules(("er", "aae"), ("aae", "n"), ("b", "*c*"))
    linted = []
    after = fix_incremental(docs, slices, own, table, linted).collect()
    whole = fix(docs, lambda rows: lint_slices(slices(rows), own), table).collect()
    assert sorted((str(r.doc_id), r.text, r.passes) for r in after) == sorted((str(r.doc_id), r.text, r.passes) for r in whole)
    assert len({r.passes for r in after}) > 1 and len(linted) > 2


def test_only_touched_nodes_are_linted_again(spark):
    text = "\n".join(["quiet line"] * 500 + ["er"] + ["quiet line"] * 300 + ["aae er"])
    docs = spark.createDataFrame([(1, text), (2, "quiet\n" * 50), (3, "one\nb")], "doc_id long, text string")
    linted = []
    out = fix_incremental(docs, line_slices, rules(("er", "aae"), ("aaeaae", "en"), ("b", "c")), table, linted)
    assert {r.doc_id: r.passes for r in out.collect()} == {1: 2, 2: 1, 3: 2}
    assert linted == [802 + 51 + 2, 3]
    assert fix_incremental(docs.limit(0), line_slices, rules(("er", "aer")), table).count() == 0
    with pytest.raises(ValueError):
        fix_incremental(docs, line_slices, [r for r in active({}, "ja") if r.id == "max-ten"], table)


def test_nodes_are_linted_where_they_are(spark):
    own, docs = rules(("er", "aae"), ("aae", "n")), spark.createDataFrame(corpus(), "doc_id long, text string")
    written = []

    def keep(df, name):
        written.append(name)
        return table(df, name)

    after = fix_incremental(docs, line_slices, own, keep).collect()
    assert written and "fix-nodes" not in written  # no table of nodes, and no join with their findings
    whole = fix(docs, lambda rows: lint_slices(line_slices(rows), own), table).collect()
    assert sorted((str(r.doc_id), r.text, r.passes) for r in after) == sorted((str(r.doc_id), r.text, r.passes) for r in whole)


def test_many_terms_node_by_node(spark):
    own = rules(("er", "aae"), ("aae", "n"), ("b", "*c*"), ("語", "x"), ("é", "語"))  # more than are searched as expressions
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    after = fix_incremental(docs, line_slices, own, table).collect()
    whole = fix(docs, lambda rows: lint_slices(line_slices(rows), own), table).collect()
    assert sorted((str(r.doc_id), r.text, r.passes) for r in after) == sorted((str(r.doc_id), r.text, r.passes) for r in whole)
