"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

Lines become 128-bit hashes of their keys.  Documents are taken in batches of
falling ``doc_id``.  A batch is reduced to a run of (hash, documents, keeper), dealt
into buckets by hash and sorted there; it is merge-anti-joined against the runs'
hashes that are already settled (held by enough documents, so that nothing later can
change them) and the rest is added as a new run.  When ``fan_out`` runs stand on one
level they are compacted by merge joins into one run of the next.  Runs are bucketed
tables: they come into these joins as they were written, without another exchange or
sort; only a new batch is dealt and sorted.  The last compaction gives every hash its
number of documents and its keeper, the largest document holding it.

Hot lines: a hash is summed before each shuffle, and the join that finds the
lines to drop is a plain sort-merge join, whose large partitions AQE splits.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, ids_and_text, materialise, sorted_run, with_runs

BLANKS = " \t\n\x0b\f\r"
HASH = ["h1", "h2"]


def line_key(line):
    return F.translate(F.btrim(line, F.lit(BLANKS)), ascii_uppercase, ascii_lowercase)


class LineRuns:
    """Levelled sorted runs; a row is (h1, h2, n, keeper)."""

    def __init__(self, spark: SparkSession, min_docs: int, parts: int, fan_out: int):
        self.spark, self.min_docs, self.parts, self.fan_out, self.levels = spark, min_docs, parts, fan_out, []

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run of all: a full merge join after another."""
        together = runs[0]
        for run in runs[1:]:
            own = run.select(*HASH, F.col("n").alias("n2"), F.col("keeper").alias("k2"))
            both = together.join(own.hint("merge"), HASH, "full")
            together = both.select(*HASH, (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("keeper", "k2").alias("keeper"))
        return together

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(sorted_run(run, "line_run", HASH, self.parts))
        if len(self.levels[level]) >= self.fan_out:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merged(runs))
            discard(*runs)

    def fresh(self, batch: DataFrame) -> DataFrame:
        """A batch as a run, without the hashes that the runs have settled.

        batch: one row per (h1, h2, doc_id) at least; repeats within a document count once.
        """
        own = batch.select(*HASH, "doc_id").distinct().groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        for run in (r for level in self.levels for r in level):
            settled = run.where(F.col("n") >= self.min_docs).select(F.col("h1").alias("s1"), F.col("h2").alias("s2")).hint("merge")
            # with a look at n the join stays above the sums, which shrink hot lines
            own = own.join(settled, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")) & (F.col("n") >= 1), "left_anti")
        return own

    def add(self, batch: DataFrame) -> None:
        with with_runs(self.spark, self.parts):
            self._put(0, self.fresh(batch))

    def repeated(self) -> DataFrame:
        """(h1, h2, keeper) of the lines that enough documents hold; the runs go."""
        runs = [r for level in self.levels for r in level]
        with with_runs(self.spark, self.parts):
            out = materialise(self._merged(runs).where(F.col("n") >= self.min_docs).select(*HASH, "keeper"), "repeated-lines")
        discard(*runs)
        self.levels = []
        return out


#: Lines of a batch and of a bucket, while there are few.
BATCH, BUCKET = 100_000_000, 500_000
#: Batches come one after another, so they are few; buckets grow with the lines then, up to what a table can have.
MOST_BATCHES, LARGE_BUCKET, MANY, MOST = 12, 4_000_000, 512, 100_000


def layout(lines: int, batches: int | None = None) -> tuple[int, int]:
    """(batches, buckets of a run); there are three batches at least, so that runs of two levels take part at every size."""
    batches = batches or min(MOST_BATCHES, max(3, -(-lines // BATCH)))
    return batches, min(MOST, max(1, -(-lines // LARGE_BUCKET), min(MANY, -(-lines // (3 * BUCKET)))))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int | None = None, fan_out: int = 2) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, kept_text, rest) for every row of ``docs``; rest holds its other columns.

    A line's key is the line without blanks at its ends and with A-Z lower-cased.
    Keys of ``min_chars`` code points or more that ``min_docs`` documents hold
    lose all lines outside the largest ``doc_id`` that holds them.  Null and
    empty text is one empty line; nothing is dropped from it.  Rows that share a
    ``doc_id`` are one document when documents are counted; a null ``doc_id`` is
    a document of its own, smaller than all.  A document whose lines all go has
    the empty text.  Ids must be numbers.  An empty table gives no row.
    """
    base = ids_and_text(docs, carry=True).withColumn("row_key", F.xxhash64("text"))
    lines = (
        base.select("doc_id", "row_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "row_key", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "row_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    lines = materialise(lines, "lines")
    batches, parts = layout(lines.count(), batches)
    cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []

    runs, above = LineRuns(docs.sparkSession, min_docs, parts, fan_out), F.lit(True)
    try:
        for cut in sorted(set(cuts), reverse=True):
            runs.add(lines.where(above & (F.col("doc_id") > cut)))
            above = F.col("doc_id") <= cut
        runs.add(lines.where(above | F.col("doc_id").isNull()))
        repeated = runs.repeated()
    finally:
        discard(*(r for level in runs.levels for r in level))  # none, but after a failure

    dropped = (
        lines.join(repeated.hint("merge"), HASH)
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("d_id"), F.col("row_key").alias("d_key"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    joined = base.join(dropped, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("row_key") == F.col("d_key")), "left")
    rest = ["rest"] if "rest" in base.columns else []
    parts = joined.select("doc_id", "text", *rest, F.split("text", "\n", -1).alias("parts"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone")), lambda i: F.get(F.col("parts"), i)), "\n")
    )
    return parts.select("doc_id", "text", F.size("parts").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), kept.alias("kept_text"), *rest)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, (r.key IS NOT NULL AND k.doc_id <> r.keeper) AS gone
      FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
