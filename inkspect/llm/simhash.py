"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into two segments; two fingerprints that differ in at
most three bits have a segment in which they differ in at most one.  So every
segment is indexed once for each of its bits with that bit wiped out, and
fingerprints meet by equality on (segment, wiped bit, other bits).  Those that
meet are verified on all 64 bits.

Only different fingerprints are compared: copies are one fingerprint with its
smallest document.  A bucket of more than ``bucket`` fingerprints is not paired.
Its members are indexed again on the bits that the bucket leaves open, cut in two
in the same way, until buckets are small; after six turns every bit is fixed or
wiped, so this ends and loses no pair.

Both sides of each join grow with the input, so they are merged on the executors;
none is collected by the driver to be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, free_name, ids_and_text, materialise, slices
from .components import components

CHUNK = 1 << 16


def hashed(text: str, shingle: int) -> Iterator[np.ndarray]:
    """The XXH64 (seed 42) of a text's shingles in their order, repeats included, some at a time; without words none."""
    words = text.encode().lower().split()  # on bytes: A-Z, and the six blanks of ASCII
    for at in range(0, max(1, len(words) - shingle + 1) if words else 0, CHUNK):
        part = words[at : at + CHUNK + shingle - 1]
        joined = [b" ".join(part)] if len(part) < shingle else map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        yield np.array([xxhash.xxh64_intdigest(x, 42) for x in joined], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit integer; of none 0."""
    ones, n = np.zeros(64, np.int64), 0
    for h in parts:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint(text: str, shingle: int) -> int:
    """Bits set in over half of the shingles' XXH64 (seed 42), as a signed 64-bit integer."""
    return majority(hashed(text, shingle))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp): rows are independent, repeated ones repeated; null text is empty; no words: 0; an empty table gives none."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t or "", shingle) for t in part.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return ids_and_text(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _variants(rows: DataFrame, width: int) -> DataFrame:
    """Index rows (path, fp, off) on the ``width`` bits from ``off``: (path, fp, off) one turn further."""
    half = width // 2
    i = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("i")
    turned = rows.select("path", "fp", "off", i).withColumn("side", F.floor(F.col("i") / half).cast("int")).withColumn("bit", F.pmod("i", F.lit(half)))
    fixed = F.expr(f"shiftrightunsigned(fp, off + side * {half}) & {(1 << half) - 1}L & ~shiftleft(1L, bit)")
    return turned.select(F.xxhash64("path", "i", fixed).alias("path"), "fp", (F.col("off") + (1 - F.col("side")) * half).alias("off"))


def links(distinct: DataFrame, max_bits: int, bucket: int = 48, tables: list[DataFrame] | None = None) -> DataFrame:
    """(u, v), u < v: all pairs of different fingerprints at ``max_bits`` or fewer bits; tables that it reads are added to ``tables``."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments serve at most three differing bits")
    rows, width, found = distinct.select(F.lit(0).cast("long").alias("path"), "fp", F.lit(0).alias("off")), 64, None
    while True:
        variants = _variants(rows, width)
        width //= 2
        sizes = variants.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = materialise(variants.join(sizes.hint("merge"), "path"), "buckets")
        if tables is not None:
            tables.append(met)
        small = met.where(F.col("n") <= bucket) if width > 1 else met
        pairs = (
            small.select("path", F.col("fp").alias("u"))
            .join(small.select("path", F.col("fp").alias("v")).hint("merge"), "path")
            .where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits))
            .select("u", "v")
            .distinct()
        )
        found = pairs if found is None else found.unionByName(pairs)
        rows = met.where(F.col("n") > bucket).select("path", "fp", "off")
        if width == 1 or rows.isEmpty():
            return found


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links.  Texts without words
    have fingerprint 0 and are linked like others.  Null ids take part but never
    name a component unless it has no other id.  Repeated rows are repeated.
    """
    prints = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct, max_bits))
    placed = materialise(distinct.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("of"), "first", F.coalesce("root", "fp").alias("root")), "roots")
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(names.hint("merge"), "root").select("of", "component_id")
    return prints.join(named.hint("merge"), F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """The rows of ``docs``, unchanged, whose id names their component; rows that repeat such an id all stay."""
    first = free_name(docs, "first")
    firsts = near_duplicates(docs, shingle, max_bits).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(first)).distinct()
    return docs.join(firsts, F.col("doc_id").eqNullSafe(F.col(first)), "left_semi")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
