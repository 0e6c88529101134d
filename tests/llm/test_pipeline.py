"""The pipeline's stages on a small corpus."""

import corpus_pipeline
from inkspect.llm import simhash
from inkspect.llm.common import materialise


def corpus():
    base = ["the quick brown fox jumps over the lazy dog number " + str(i) + " and then " + " ".join(f"word{i}x{k} of the" for k in range(60)) for i in range(30)]
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = base + [base[0], base[1], "12345 !!", None, ""] + [base[i] + f" tail{i} " + passage for i in range(10, 13)]
    texts = [t + "\nA line that all documents of this corpus hold" if t else t for t in texts]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def test_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        seen.append({r.doc_id: r for r in docs.collect()})
    language, lines, near, parts = seen
    assert set(rows[i][0] for i in range(len(rows))) - set(language) == {33, 34}
    held = [i for i, r in lines.items() if "all documents" in r.text]
    assert held == [max(language)] and all(r.n_chars == len(r.text) for r in lines.values())
    assert {30, 31} & set(near) == set() and {0, 1} <= set(near)
    prints = {i: simhash.fingerprint(r.text, 5) for i, r in lines.items()}
    for i in near:
        for j in near:
            assert i == j or bin((prints[i] ^ prints[j]) & (2**64 - 1)).count("1") > 3
    assert all(r.n_chars == len(r.text) for r in parts.values())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(parts) and sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


CLASHES = "doc_id long, text string, lang string, rest string, block int, mark string, node int, `near mark` string, h1 long, part int, at int, d_id long, n_chars int"


def test_stages_on_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, empty texts, columns that clash with those of the operators; and no rows at all."""
    long = " ".join(f"w{i} of it" for i in range(200))
    own = [(1, long, "en"), (1, long, "en"), (None, long + " end", "en"), (None, None, None), (2, "", "en"), (3, " \n", None), (4, "one line\n" * 3, "en"), (4, "another text of the same id", "en"), (5, long.upper(), "en")]
    rows = [(i, t, lang, "r", 1, "m", 2, "x", 3, 4, 5, 6, None if t is None else len(t)) for i, t, lang in own]
    for name, table in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(table, CLASHES).write.parquet(str(folder / "documents.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        schema, kept = docs.schema, {}
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = materialise(f(spark, docs, str(folder)), stage)
            assert [(c.name, c.dataType) for c in docs.schema] == [(c.name, c.dataType) for c in schema]
            kept[stage] = [(r.doc_id, r.text) for r in docs.collect()]
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(folder)).collect()
        if not table:
            assert not pieces and not any(kept.values())
            continue
        assert sorted(str(i) for i, _ in kept["language_id"]) == ["1", "1", "4", "4", "5", "None"]
        near = kept["simhash_near_dedup"]
        assert sorted(str(i) for i, _ in near) == ["1", "4", "4"] and (1, long) in near
        assert {p.doc_id for p in pieces} == {1, 4}
