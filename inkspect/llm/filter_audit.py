"""Filter interaction audit: what each of five filters removes in every order they can be applied.

Documents that repeat an earlier text are found over an RDD that is routed by
fingerprint.  A task computes XXH64 of each text and keeps collision chains, under
each fingerprint the different full texts with the smallest id so far; an id that isn't
the smallest of its text is known there and travels without text.  What is left, one
text a task, is partitioned by fingerprint and sorted; there a chain is met as a run,
texts are compared in full, the first id of each text is the smallest, and all others
are emitted.  A text that a third of all rows hold is so shuffled once a task, and no
task holds more than a bounded store of texts or one chain.

Each document then is a mask of the filters that it fails.  combineByKey merges vectors
of counts by mask, 32 for each part and label, and every order's figures are sums over
these vectors.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fields, materialise, plain_text, slices

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
MARKS = re.compile(rb"[#$%&*|]")
BLANK = re.compile(rb"[ \t-\r]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of a text that are taken apart at once.
CHUNK = 1 << 20
#: Bytes of texts that a task keeps before it passes them on.
STORE = 32 << 20

RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def word_counts(data: bytes) -> tuple[int, int]:
    """(words, different words); words are what blanks of ASCII part."""
    n, seen, at = 0, set(), 0
    while at < len(data):
        cut = BLANK.search(data, at + CHUNK)
        end = cut.start() if cut else len(data)
        words = data[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def failing(text: str, data: bytes, min_words: int, distinct_percent: int, capital_percent: int) -> int:
    """The bits of filters A to D that a text fails."""
    words, different = word_counts(data)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    fails = (words < min_words, 100 * different < distinct_percent * words, 100 * capitals > capital_percent * len(text), bool(MARKS.search(data)))
    return sum(1 << i for i, x in enumerate(fails) if x)


class Chains:
    """Under each fingerprint the different texts with their smallest id, up to a number of bytes."""

    def __init__(self):
        self.by_print: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, code: int, data: bytes, doc_id) -> list:
        """Put a document in; the ids, none or one, now known not to be the smallest of their text."""
        chain = self.by_print.setdefault(code, [])
        for entry in chain:
            if entry[0] == data:
                least = entry[1]
                entry[1] = min(least, doc_id)
                return [] if doc_id == least else [max(least, doc_id)]
        chain.append([data, doc_id])
        self.bytes += len(data) + 200
        return []

    def drain(self):
        """All (fingerprint, text, id); the store is empty then."""
        for code, chain in self.by_print.items():
            for data, doc_id in chain:
                yield code, data, doc_id
        self.by_print, self.bytes = {}, 0


def _routes(store: int, fingerprint):
    """From rows (doc_id, text) to pairs ((fingerprint, kind, id), text); kind 0 is known to repeat a text and has none."""

    def run(rows):
        chains = Chains()
        for doc_id, text in rows:
            data = text.encode()
            code = fingerprint(data)
            for known in chains.add(code, data, doc_id):
                yield (code, 0, known), None
            if chains.bytes >= store:
                for code, data, doc_id in chains.drain():
                    yield (code, 1, doc_id), data
        for code, data, doc_id in chains.drain():
            yield (code, 1, doc_id), data

    return run


def _signed(code: int) -> int:
    return code - (code >> 63 << 64)


def _not_the_smallest(pairs):
    """Sorted pairs of ``_routes`` to (id, fingerprint) of all that repeat the text of a smaller id."""
    last, chain = None, []
    for (code, kind, doc_id), data in pairs:
        if not kind:
            yield doc_id, _signed(code)
            continue
        if code != last:
            last, chain = code, []
        first = next((i for text, i in chain if text == data), None)
        if first is None:
            chain.append((data, doc_id))
        elif first != doc_id:
            yield doc_id, _signed(code)


def repeating(docs: DataFrame, store: int = STORE, fingerprint=xxhash.xxh64_intdigest) -> DataFrame:
    """(doc_id, code) of the documents whose text has a smaller id, with its fingerprint.

    Null ids are neither smaller nor larger than others.  Rows that repeat an id and a
    text come once each at most.  Ids may be of any type that has an order.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", plain_text().alias("text")).rdd
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.getNumPartitions())
    # known ids are dealt by themselves, not with all others of a text
    sorted_ = rows.mapPartitions(_routes(store, fingerprint)).repartitionAndSortWithinPartitions(tasks, lambda key: key[0] if key[1] else hash((key[0], xxhash.xxh64_intdigest(repr(key[2])))))
    return spark.createDataFrame(sorted_.mapPartitions(_not_the_smallest), fields(docs, "code long"), verifySchema=False)


def masks(
    docs: DataFrame, part: str = "lang", min_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10, store: int = STORE, fingerprint=xxhash.xxh64_intdigest
) -> DataFrame:
    """(doc_id, part, mask) for every row of ``docs``: the filters failed, bit 0 for A to bit 4 for E.

    A: under ``min_words`` words; B: under ``distinct_percent`` of the words are
    different; C: over ``capital_percent`` of the code points are A-Z; D: holds one of
    ``#$%&*|``; E: the same text has a smaller id.  Null text is empty, a null part the
    empty string.  Null ids never fail E nor make others fail it; rows that repeat an
    id and a text fail E only where a smaller id has the text.  Other columns don't
    matter.  An empty table gives no row.
    """

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(2)):
                own = batch.slice(a, b - a)
                texts = [(text, text.encode()) for text in own.column(2).to_pylist()]
                bits = [failing(*x, min_words, distinct_percent, capital_percent) for x in texts]
                codes = [_signed(fingerprint(data)) for _, data in texts]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(bits, pa.int32()), pa.array(codes, pa.int64())], ["doc_id", "part", "bits", "code"])

    rows = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), plain_text().alias("text"))
    found = materialise(rows.mapInArrow(run, fields(docs, "part string, bits int, code long")), "filter-bits")
    again = repeating(docs, store, fingerprint).distinct().select(F.col("doc_id").alias("of"), F.col("code").alias("same"))
    named = found.where("doc_id IS NOT NULL").join(again, (F.col("doc_id") == F.col("of")) & (F.col("code") == F.col("same")), "left")
    mask = F.col("bits").bitwiseOR(F.when(F.col("of").isNull(), 0).otherwise(REPEATED))
    return named.select("doc_id", "part", mask.alias("mask")).unionByName(found.where("doc_id IS NULL").select("doc_id", "part", F.col("bits").alias("mask")))


def _vector() -> np.ndarray:
    """Rows by mask: all, good, toxic."""
    return np.zeros((3, 1 << len(FILTERS)), np.int64)


def _added(vector: np.ndarray, row) -> np.ndarray:
    mask, good, toxic = row
    vector[:, mask] += (1, good, toxic)
    return vector


def orders(part: str, counts: np.ndarray):
    """The rows of RESULT for one part: every order's steps from counts by mask."""
    every = np.arange(counts.shape[1])
    out, shapley = [], Counter()
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            own = 1 << FILTERS.index(name)
            fails, passed = every & own != 0, every & before == 0
            removed = fails & passed
            lost, good, toxic = counts[:, removed].sum(1).tolist()
            shapley[name] += lost
            out.append((name, "".join(order), step, int(counts[0, every & (before | own) == 0].sum()), lost, int(counts[0, fails & ~passed].sum()), int(counts[0, own]), good, toxic))
            before |= own
    return [(part, *row, shapley[name]) for name, *row in out]


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row for each part, order of the five filters and step, zeros included; the
    step's filter is that letter of the order.  labels: doc_id, quality, toxic; a
    document is good or toxic if any row of its id says 1.  Nulls, repeats and empty
    tables are as in ``masks``, whose ``options`` these are; a document without a label
    is neither good nor toxic.
    """
    spark = docs.sparkSession
    found = materialise(masks(docs, **options), "filter-masks")
    flag = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)).cast("int")).alias(name)
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(flag("quality"), flag("toxic"))
    named = found.where("doc_id IS NOT NULL").join(marked, F.col("doc_id") == F.col("of"), "left").select("part", "mask", F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    rows = named.union(found.where("doc_id IS NULL").select("part", "mask", F.lit(0), F.lit(0)))
    pairs = rows.rdd.map(lambda x: (x[0], tuple(x)[1:]))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = pairs.combineByKey(lambda row: _added(_vector(), row), _added, lambda a, b: a + b, tasks)
    return spark.createDataFrame(vectors.flatMap(lambda x: orders(*x)), RESULT, verifySchema=False)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, part, text, length(text) AS chars,
         regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS capitals,
         min(doc_id) OVER (PARTITION BY text) AS first_id
  FROM t),
m AS (
  SELECT w.doc_id, part,
         (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * capitals > 10 * chars THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN first_id < w.doc_id THEN 16 ELSE 0 END) AS mask
  FROM w),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)),
o AS (
  SELECT '' AS filter_order, 0 AS used, 0 AS step
  UNION ALL
  SELECT filter_order || name, used | bit, step + 1 FROM o JOIN f ON used & bit = 0 WHERE step < 5),
s AS (
  SELECT a.filter_order, i AS step, f.name, f.bit,
         (SELECT coalesce(sum(g.bit), 0)::INTEGER FROM f AS g WHERE strpos(substr(a.filter_order, 1, (i - 1)::INTEGER), g.name) > 0) AS before
  FROM o AS a CROSS JOIN range(1, 6) AS r(i) JOIN f ON f.name = substr(a.filter_order, i::INTEGER, 1)
  WHERE a.step = 5),
x AS (
  SELECT part, filter_order, step, s.name,
         coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM s CROSS JOIN c GROUP BY part, filter_order, step, s.name)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley
FROM x
"""
