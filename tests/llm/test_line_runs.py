"""How runs of line hashes are written."""

import os

from inkspect.llm import common


def test_a_run_has_few_files_whatever_it_was_dealt_to(spark):
    rows = spark.range(4000).selectExpr("id % 97 AS h1", "id AS h2").repartition(60, "h1")
    run = common.sorted_run(rows, "few_files", ["h1"], 2)
    try:
        files = [f for f in os.listdir(run.written.removeprefix("file://")) if f.endswith(".parquet")]
        assert len(files) <= 2 * max(2, spark.sparkContext.defaultParallelism) < 60
        assert sorted(x.h2 for x in run.collect()) == list(range(4000))
    finally:
        common.discard(run)
