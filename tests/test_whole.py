"""Queries that must take the whole of their input, against brute force."""

import re

from inkspect import queries


def test_position_map_takes_whole_texts(spark, tmp_path):
    texts = ["b" * 2500 + "a", "a" + "x😀é\r\n" * 700 + "aab\n\na" * 120, "\n" * 2100 + "😀a", "none", "", None, "aaa"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    expected = []
    for i, text in enumerate(texts):
        text = (text or "").translate(str.maketrans("aeiou", "ｱｴｲｵｳ"))
        for m in re.finditer("ｱ+", text):
            before = text[: m.start()]
            last = before.rpartition("\n")[2]
            expected.append((i, len(before.encode()), before.count("\n") + 1, len(last) + 1, len(last.encode("utf-16-be")) // 2 + 1))
    out = [tuple(x) for x in queries.position_map(spark, str(tmp_path)).collect()]
    assert sorted(out) == expected
    assert sum(x[1] >= 2000 for x in out) > 100
