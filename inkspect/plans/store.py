"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session of one machine names none, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='inkspect-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` under the shared folder, with ``by`` in a folder for each of its values (two), and read it back.

    The shuffle files behind the table are of no more use then and go at once.
    """
    spark, path = df.sparkSession, f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    own |= {"spark.sql.maxConcurrentOutputFileWriters": "2"} if by else {}  # else rows are sorted by ``by``
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def drop(table: DataFrame, part: str = "") -> None:
    """Delete a table of ``table``, or one folder (``name=value``) of it, that nothing will read any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{table.written}/{part}".rstrip("/"))
    path.getFileSystem(conf).delete(path, True)
