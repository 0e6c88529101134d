"""What the fixpoint over whole documents leaves on disk and moves between tasks."""

import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspect import queries
from inkspect.operators import fixes
from inkspect.operators.fixes import fix, fix_terms
from inkspect.plans import store
from inkspect.plans.config import Setting, active
from inkspect.plans.linter import lint_slices
from inkspect.sources.plain import plain_slices

ROWS = [(1, "er " * 40), (2, "quiet"), (3, "aae er"), (4, None), (5, ""), (6, "b"), (None, "é er")]


def rules(*terms):
    return [r for r in active({"ja-prh": Setting(options={"terms": [{"expected": x, "pattern": p} for p, x in terms]})}, "ja") if r.id == "ja-prh"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


@pytest.fixture
def written(spark):
    """The folders of tables that are written meanwhile."""
    shared = store.folder(spark).removeprefix("file://")
    before = set(glob.glob(f"{shared}/*"))
    return lambda: {name.split("-" + name.rsplit("-", 1)[1])[0]: sorted(os.path.basename(p) for p in glob.glob(f"{shared}/{name}/*=*")) for name in map(os.path.basename, set(glob.glob(f"{shared}/*")) - before)}


OWN = rules(("er", "aer"), ("aae", "en"), ("b", "bb"))
PASSES = 5  # for time
#: Each pass adds one b, as all but the last stand where its term is spelled right; er ends after four passes.
WANT = {1: ("enr " * 40, 4), 2: ("quiet", 1), 3: ("en enr", 4), 4: ("", 1), 5: ("", 1), 6: ("b" * (1 + PASSES), PASSES), None: ("é enr", 4)}


def test_what_a_pass_changed_goes_once_the_next_is_written(docs, written, monkeypatch):
    monkeypatch.setattr(fixes, "PASSES", PASSES)
    out = fix(docs, lambda now: lint_slices(plain_slices(now), OWN), store.table)
    left = written()
    assert "fix-0" not in left and left[f"fix-{PASSES}"] == ["changed=true"]
    assert [left[f"fix-{n}"] for n in range(1, PASSES)] == [["changed=false"] if n in (1, 4) else [] for n in range(1, PASSES)]
    assert {r.doc_id: (r.text, r.passes) for r in out.collect()} == WANT


def test_passes_need_no_table_and_no_exchange(spark, tmp_path, written):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.queries()["fix_fixpoint"](spark, str(tmp_path))
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan  # documents are dealt out once
    assert {r.doc_id: r.passes for r in out.collect()} == {1: 4, 2: 1, 3: 4, 4: 1, 5: 1, 6: 1, None: 4} and not written()


def test_terms_where_they_are_equal_the_fixes_of_the_rule(spark, monkeypatch):
    monkeypatch.setattr(fixes, "PASSES", 3)
    own = random.Random(9)
    rows = [(i, "".join(own.choice(["a", "b", "ab", "é", "語", " "]) for _ in range(own.randrange(14)))) for i in range(120)]
    docs = spark.createDataFrame([*rows, (None, "ab"), (500, None)], "doc_id long, text string").coalesce(1)
    for terms in ([("a", "b"), ("b", "aa"), ("ab", "é"), ("ab", "c")], [("aba", "x"), ("ba", "ab"), ("bab", ""), ("é", "é語")], [("a", ""), ("b", "ab"), ("語", "a")]):
        whole = fix(docs, lambda now, terms=terms: lint_slices(plain_slices(now), rules(*terms)), store.table)
        assert sorted(map(str, fix_terms(docs, terms).select("doc_id", "text", "passes").collect())) == sorted(map(str, whole.collect()))


def test_spans_taken_equal_the_plain_loop():
    own = random.Random(10)
    for _ in range(500):
        spans = sorted(((a := own.randrange(20), a + own.randrange(1, 6)) for _ in range(own.randrange(1, 10))), key=lambda s: (s[0], -s[1]))
        want, past = [], 0
        for a, b in spans:
            want.append(a >= past)
            past = b if a >= past else past
        assert fixes.taken(*(np.array(x, np.int64) for x in zip(*spans))).tolist() == want


def test_shuffle_files_behind_a_table_go(spark):
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = held()
    out = store.table(spark.range(1000).repartition(7), "dealt")
    assert held() <= before and out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false" and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_a_table_in_two_folders_is_not_sorted_and_may_be_empty(spark):
    rows = spark.range(9).select("id", (F.col("id") % 3 == 0).alias("changed"))
    out = store.table(rows, "parts", "changed")
    store.drop(out, "changed=true")
    assert sorted(r.id for r in out.where("NOT changed").collect()) == [1, 2, 4, 5, 7, 8]
    nothing = store.table(rows.where("id < 0"), "parts", "changed")
    assert nothing.count() == 0 and nothing.dtypes == rows.dtypes
    store.drop(nothing)
    assert not os.path.exists(nothing.written.removeprefix("file://"))


def test_no_documents(spark):
    assert fix_terms(spark.createDataFrame([], "doc_id long, text string"), [("a", "b")]).collect() == []
