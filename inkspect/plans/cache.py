"""Result cache: a key per document, hits by semi join, misses by anti join."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Active
from .store import table

VERSIONS = {"key": 2, "engine": 1, "parser": 1}


def settings_digest(rules: list[Active], processor: str, dictionary: str | None = None) -> str:
    """What besides the text decides a result; the dictionary counts only where a token rule is active."""
    from ..operators.registry import RULES, TOKENS

    uses = any(RULES[r.id].scope == TOKENS for r in rules)
    return json.dumps([VERSIONS, processor, [[r.id, r.options, r.severity] for r in rules], dictionary if uses else None], sort_keys=True, ensure_ascii=False)


def cache_key(text: Column, settings: str) -> Column:
    """SHA-256 over length-prefixed fields."""
    text = F.coalesce(text, F.lit(""))
    return F.sha2(F.concat_ws("|", F.octet_length(text).cast("string"), text, F.lit(len(settings.encode())).cast("string"), F.lit(settings)), 256)


def split(docs: DataFrame, cached: DataFrame, settings: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): documents with a cache_key that the cache has, or has not."""
    keyed = docs.withColumn("cache_key", cache_key(F.col("text"), settings))
    keys = cached.select("cache_key")
    return keyed.join(keys, "cache_key", "left_semi"), keyed.join(keys, "cache_key", "left_anti")


def lint_cached(docs: DataFrame, cached: DataFrame, settings: str, find) -> tuple[DataFrame, DataFrame]:
    """(diagnostics, new cache entries).  cached: (cache_key, diagnostics array); find(docs) gives diagnostics."""
    hits, misses = split(docs, cached, settings)
    fields = ["slice_id", "rule_id", "severity", "message", "start", "end", "fixes"]
    fresh = find(misses)
    found = fresh.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(F.struct(*fields)).alias("diagnostics"))
    rows = misses.select("doc_id", "cache_key").join(found, F.col("doc_id").eqNullSafe(F.col("d")), "left")
    empty = F.array().cast(found.schema["diagnostics"].dataType)
    entries = rows.groupBy("cache_key").agg(F.first(F.coalesce("diagnostics", empty)).alias("diagnostics"))
    old = hits.select("doc_id", "cache_key").join(cached, "cache_key").select("doc_id", F.inline("diagnostics"))
    return fresh.select("doc_id", *fields).unionByName(old), entries


ENTRY = "cache_key string, diagnostics array<struct<slice_id:bigint,rule_id:string,severity:string,message:string,start:int,end:int,fixes:array<struct<start:int,end:int,replacement:string>>>>"


class Store:
    """Results of earlier runs in a folder of Parquet tables, one a run, under the versions that made them.

    What other versions have left is not read; a store that can't be read is empty.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/" + "-".join(f"{k}{v}" for k, v in sorted(VERSIONS.items()))

    def load(self) -> DataFrame:
        try:
            return self.spark.read.schema(ENTRY).parquet(self.path).dropDuplicates(["cache_key"])
        except AnalysisException:
            return self.spark.createDataFrame([], ENTRY)

    def save(self, entries: DataFrame) -> None:
        entries.select("cache_key", "diagnostics").write.mode("append").parquet(self.path)

    def lint(self, docs: DataFrame, settings: str, find) -> DataFrame:
        """Diagnostics of ``docs``; find(misses) is run for the rest, and its results are kept."""
        held = self.load()
        fresh = lint_cached(docs, held, settings, find)[1]
        new = table(fresh, "cache-entries")
        self.save(new)
        keyed = docs.withColumn("cache_key", cache_key(F.col("text"), settings)).select("doc_id", "cache_key")
        return keyed.join(held.unionByName(new).dropDuplicates(["cache_key"]), "cache_key").select("doc_id", F.inline("diagnostics"))
