"""What of op5 reaches the driver."""

from inkspect.llm import components, simhash


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_op5_sends_nothing_to_the_driver_to_be_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of text {i % 7} and {i % 5}") for i in range(60)], "doc_id long, text string")
    plans, write = [], simhash.materialise

    def watched(df, name, *more):
        plans.append(plan_of(df))
        return write(df, name, *more)

    monkeypatch.setattr(simhash, "materialise", watched)
    monkeypatch.setattr(components, "materialise", watched)
    out = simhash.near_duplicates(docs)
    plans.append(plan_of(out))
    assert out.count() == 60 and len(plans) > 5
    assert not any("Broadcast" in p for p in plans)
