"""Tables of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table, as far as the plan knows, for each task.
SHARE = 4 << 20


def spread(df: DataFrame, by: str | None = None) -> DataFrame:
    """A table over all cores, in shares that don't grow with it.

    It may have few row groups, each of which one task reads, while rules take much time
    for a byte: such a task would take as long as its row group is large.  So rows are
    dealt out anew, whatever the size, in tasks of ``SHARE`` bytes, two a core at least.
    With ``by`` all rows of an id are dealt to one task, so that windows over ids need no
    exchange of what is made of the rows.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // SHARE))
    return df.repartition(parts, by) if by else df.repartition(parts)


def documents(spark: SparkSession, path: str, by: str | None = None) -> DataFrame:
    """A Parquet table of documents, spread."""
    return spread(spark.read.parquet(path), by)
