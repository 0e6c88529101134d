"""Exact dedup by content sort (DataFrame functions only).

Normalised texts are range-partitioned by sampled splitters and sorted there: by
their beginning, by a hash of all of it (so that what is sampled is short, and texts
that begin alike can be parted), and by all of their bytes.  Equal texts are then
neighbours, a window compares each with the one before in full, and its group is the
run of equals: the row that stays and the size of the group are known there.

A content that holds a large share of all rows would be one partition.  A sample of
hashes finds such contents (their number is bounded by their share), and only these
are salted; their parts are merged by SHA-256, a row per content and salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, ids_and_text, materialise

BLANKS = " \t\n\x0b\f\r"


def hot_contents(keyed: DataFrame, sample_rows: int, least: int) -> list[int]:
    """Hashes of contents that hold over a quarter of a partition's share of the rows, by a sample of about ``sample_rows``.

    With p shuffle partitions these are 4 p contents at most; ``least`` is how often
    a content must be in the sample to be judged.
    """
    spark, rows = keyed.sparkSession, keyed.count()
    sample, taken = keyed, min(rows, sample_rows)
    if rows > sample_rows:
        sample = keyed.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(sample_rows / rows * (1 << 30)))
    share = taken / (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = sample.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return [r.code for r in counts.where(F.col("n") > max(least, share)).select("code").collect()]


def grouped_by_sort(docs: DataFrame, salts: int, sample_rows: int, least: int) -> tuple[DataFrame, int]:
    """((doc_id, chars, salt, n, best, digest), number of hot contents): rows with what the neighbours in the sort tell; salt is -1 but for hot contents."""
    base = ids_and_text(docs).select("doc_id", F.char_length("text").alias("chars"), F.translate("text", BLANKS, "").alias("content"))
    keyed = base.withColumn("head", F.substring("content", 1, 24)).withColumn("code", F.xxhash64("content"))
    hot = hot_contents(keyed, sample_rows, least)
    salt = F.when(F.col("code").isin(hot), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(-1) if hot else F.lit(-1).cast("long")
    dealt = ["head", "code", *(["salt"] if hot else [])]
    run = Window.partitionBy(*dealt, "content")  # within what the splitters have dealt: no other exchange
    best = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), "doc_id")  # the least: most code points, then smallest id
    sorted_ = keyed.withColumn("salt", salt).repartitionByRange(*dealt)
    rows = sorted_.select("doc_id", "chars", "salt", F.count(F.lit(1)).over(run).alias("n"), F.min(best).over(run).alias("best"), F.unhex(F.sha2("content", 256)).alias("digest"))
    return rows, len(hot)


def dedup_exact(docs: DataFrame, salts: int = 256, sample_rows: int = 1_000_000, least: int = 32) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for every row of ``docs``.

    Texts are equal when identical without their blanks; null is empty, and all
    empty texts are one group.  The row with the most code points stays, then the
    smallest ``doc_id`` (a null id is the last choice).  Rows that repeat both id
    and length of the row that stays are marked kept as well.  Ids may be of any type
    that has an order.  An empty table gives no row.
    """
    rows, hot = grouped_by_sort(docs, salts, sample_rows, least)
    if hot:
        rows = materialise(rows, "sorted-contents")
        parts = rows.where("salt >= 0").groupBy(F.col("digest").alias("of"), "salt").agg(F.first("n").alias("n"), F.min("best").alias("best"))
        groups = parts.groupBy("of").agg(F.sum("n").alias("all"), F.min("best").alias("first"))
        merged = rows.where("salt >= 0").join(F.broadcast(groups), F.col("digest") == F.col("of"))  # as many rows as hot contents
        rows = rows.where("salt < 0").unionByName(merged.select("doc_id", "chars", "salt", F.col("all").alias("n"), F.col("first").alias("best"), "digest"))
    return rows.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("chars") == -F.col("best.chars"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_exact(documents(spark, sf_dir))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept,
       text_sha256
FROM n
"""
