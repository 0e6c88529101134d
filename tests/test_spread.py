"""What a query costs must not hang on how its table was written, nor on how often a column is used."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from inkspect import queries
from inkspect.functions.text import each_of, matches
from inkspect.plans.config import active
from inkspect.plans.linter import lint_slices
from inkspect.sources import tables
from inkspect.sources.markdown import markdown_slices
from inkspect.sources.plain import plain_slices


def plan_of(df, mode="extended"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_one_row_group_is_many_tasks_work_at_any_size(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t.parquet")
    spark.range(3000).selectExpr("id AS doc_id", "repeat(sha2(cast(id AS string), 256), 20) AS text").coalesce(1).write.parquet(path)
    monkeypatch.setattr(tables, "SHARE", 4 << 10)  # as if the table were that much larger
    for by in (None, "doc_id"):
        df = tables.documents(spark, path, by)
        sizes = [len(x) for x in df.select("doc_id").rdd.glom().collect()]
        assert sum(sizes) == 3000 and len(sizes) > 20 and max(sizes) < 400


def test_rules_are_not_worked_out_again_in_a_filter(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "doc_id long, text string").select("doc_id", F.translate("text", "b", "́").alias("text"))
    out = lint_slices(plain_slices(docs), [r for r in active({}, "ja") if r.id == "no-nfd"])
    plan = plan_of(out).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert "regexp_extract_all" in plan and not any("Filter" in line and "regexp" in line for line in plan.splitlines())
    assert [(r.doc_id, r.start, r.end) for r in out.collect()] == [(1, 2, 4)]
    rows = each_of(docs, ["doc_id"], matches(F.col("text"), "."))
    assert sorted((r.doc_id, r.start, r.end) for r in rows.collect()) == [(1, 0, 1), (1, 1, 2), (1, 2, 4)]


def test_places_of_many_matches(spark):
    own = random.Random(3)
    for n in (1, 31, 32, 33, 64, 1000):
        text = "".join(own.choice(["a", "é", "漢", "-"]) for _ in range(n))
        got = spark.createDataFrame([(text,)], "text string").select(matches(F.col("text"), "[é漢]").alias("m")).first().m
        want, at = [], 0
        for c in text:
            want += [(at, at + len(c.encode()), c)] if c in "é漢" else []
            at += len(c.encode())
        assert [tuple(m) for m in got] == want


def test_tokens_of_dealt_documents_are_not_exchanged(spark, tmp_path):
    spark.createDataFrame([(i, "aaaaaaaa bb " * 5) for i in range(9)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for rule in ("no_doubled_joshi", "no_mix_dearu_desumasu", "no_doubled_conjunction"):
        plan = plan_of(queries.queries()[rule](spark, str(tmp_path)), "formatted")
        exchanges = [line for line in plan.split("== Final")[0].splitlines() if "hashpartitioning" in line]
        assert len(exchanges) == 1 and "doc_id" in exchanges[0]


def test_markdown_is_parsed_in_slices_of_a_batch(spark, monkeypatch):
    docs, taken = spark.createDataFrame([(1, "a\n\n- b")], "doc_id long, text string"), []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, kind: taken.append((self, run)) or plain(self, run, kind))
    slices, errors = markdown_slices(docs)
    batch = taken[0][0].toArrow().to_batches()[0]
    many = pa.Table.from_batches([batch] * 3).set_column(batch.schema.names.index("text"), "text", pa.array(["x " * (1 << 20), None, "> " * 1500 + "x"], pa.string())).combine_chunks().to_batches()[0]
    out = list(taken[0][1](iter([many])))
    assert len(out) > 1 and [len(x) if x else x for b in out for x in b.column("nodes").to_pylist()] == [3, 1, None]
    assert [x is None for b in out for x in b.column("error").to_pylist()] == [True, True, False]
    assert [len(r.nodes) for r in slices.collect()] == [7] and errors.count() == 0
