"""Linting a stream of documents: the same plan, a file drop as its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import Config
from ..plans.linter import lint
from ..sources.plain import plain_slices


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files: int = 100) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def lint_stream(docs: DataFrame, config: Config | None = None) -> DataFrame:
    """Diagnostics of a stream; stateless, as every rule on text decides inside a row.  Token rules need windows and are left to batches."""
    return lint(plain_slices(docs), config)


def first_seen(docs: DataFrame, time: str, delay: str) -> DataFrame:
    """Documents whose text was not seen within ``delay``: the streaming form of the cache."""
    keyed = docs.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark(["content_hash"])
