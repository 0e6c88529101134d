"""Helpers shared by the operators: shared-folder tables, byte views of Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text handled at once by a vectorised step; arrays of eight bytes a character come from it.
SLICE_BYTES = 2 << 20


_CACHES: list = []


def kept_in_worker(f):
    """Results stay in the worker process until an operator that does not use them calls ``forget``."""
    own = lru_cache(maxsize=2)(f)
    _CACHES.append(own)
    return own


def forget() -> None:
    """Workers outlive a stage; what another operator has left in this one goes."""
    for f in _CACHES:
        f.cache_clear()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session of one machine names none (as in tests) a temporary one is
    made; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='inkspect-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of finished files and
    no recomputation of what came before.  The shuffle files behind the table are
    of no more use then and go at once.
    """
    spark, tidy = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(tidy, "false")
    spark.conf.set(tidy, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(tidy, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written = path
    return table


def sorted_run(df: DataFrame, name: str, keys: list[str], parts: int) -> DataFrame:
    """Write ``df`` as a table of ``parts`` buckets by ``keys``, each sorted by them, and read it back.

    Dealt and sorted like this it takes part in merge joins as it is, as long as
    ``with_runs`` holds and a bucket is one file, which it is where ``df`` has been
    dealt by the keys under it.  Where a session holds more shuffle partitions than
    buckets, they are written by as many tasks as there are buckets or cores: each file
    that an executor creates on a local disk starts two processes (``chmod``).
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    few = df.coalesce(max(parts, spark.sparkContext.defaultParallelism))
    few.write.option("path", path).option("compression", "zstd").format("parquet").bucketBy(parts, *keys).sortBy(*keys).saveAsTable(table)
    run = spark.table(table)
    run.written, run.named = path, table
    return run


@contextmanager
def with_runs(spark: SparkSession, parts: int) -> Iterator[None]:
    """Inside, shuffles deal into as many parts as runs have buckets, and buckets of one file are taken for sorted, which they are."""
    own = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.shuffle.partitions": str(parts)}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` and ``sorted_run`` that nothing will read any more."""
    for table in tables:
        if hasattr(table, "named"):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.named}")
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table.written)
        path.getFileSystem(conf).delete(path, True)


def plain_text(col: str = "text") -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def free_name(docs: DataFrame, base: str) -> str:
    """A name like ``base`` that is none of the columns of ``docs``."""
    return base + "_" * max(map(len, docs.columns))


def fields(docs: DataFrame, ddl: str, *more: T.StructField) -> T.StructType:
    """The type of doc_id in ``docs``, then the fields of ``ddl`` and ``more``; a struct, since names of columns may be no words."""
    return T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(ddl).fields, *more])


def ids_and_text(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(doc_id, text), and with ``carry`` a struct ``rest`` of all other columns, which so can't clash with any."""
    rest = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))).alias("rest")] if carry and len(docs.columns) > 2 else []
    return docs.select("doc_id", plain_text().alias("text"), *rest)


def with_text(docs: DataFrame, result: DataFrame, text: str) -> DataFrame:
    """``result`` (with doc_id, ``text`` and rest) in the columns of ``docs``; n_chars, where there, counts the new text."""
    n = F.char_length(F.col(text))
    new = {"doc_id": F.col("doc_id"), "text": F.col(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = n.cast(docs.schema["n_chars"].dataType)
    return result.select(*(new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; offsets start at 0, nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text each (one row at least)."""
    _, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)
