"""Packing: concatenate and cut.

Pass one encodes every document, closes it with the end id, and writes its ids
with the part (task) it was in and its offset inside that part.  The parts' token
totals are prefix-summed, which gives every part a global offset.  Pass two reads
the table again, adds the offsets, and cuts the one long sequence into fixed
windows; a document that spans windows gives a boundary record for each.  All
sequences but the last are full.

The only data that all tasks see is one total per part.  Offsets come from the
table that was written, so a part that is computed again, or a task that runs
twice, cannot shift them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import documents, ids_and_text, materialise, slices
from .tokenise import vocabulary_path

PARTS_A_GROUP = 4096


def _encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    def run(batches):
        own, part, at = codec(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], own.dtype).tobytes()
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                rows = batch.slice(a, b - a)
                ids = [own.encode(t or "") + end for t in rows.column(1).to_pylist()]
                n = np.array([len(x) // own.dtype.itemsize for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "part", "at", "n", "ids"])

    return ids_and_text(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, part long, at long, n long, ids binary")


def _offsets(table: DataFrame) -> DataFrame:
    """(part, base): exclusive prefix sums of the parts' totals, in two levels so that no window holds all parts."""
    totals = table.groupBy("part").agg(F.sum("n").alias("total")).withColumn("of", F.floor(F.col("part") / PARTS_A_GROUP))
    groups = totals.groupBy("of").agg(F.sum("total").alias("sum"))
    before = groups.select("of", (F.sum("sum").over(Window.orderBy("of")) - F.col("sum")).alias("before"))
    inside = totals.withColumn("own", F.sum("total").over(Window.partitionBy("of").orderBy("part")) - F.col("total"))
    return inside.join(before, "of").select("part", (F.col("before") + F.col("own")).alias("base"))


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    Null and empty texts are documents of the end id alone.  Repeated rows are
    packed once each.  The order is that of the input's parts; it has no meaning.
    An empty table gives no piece.
    """
    table = materialise(_encode(docs, path, end_id), "packed-ids")
    placed = table.join(F.broadcast(_offsets(table)), "part").select("doc_id", (F.col("base") + F.col("at")).alias("at"), "ids")
    itemsize, dtype = codec(path).dtype.itemsize, codec(path).dtype.str

    def run(batches):
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            ats, blobs = batch.column(1).to_pylist(), batch.column(2)
            rows: list[list] = [[] for _ in range(8)]
            for doc_id, at, blob in zip(doc_ids, ats, blobs):
                ids = np.frombuffer(blob.as_buffer(), dtype).astype("<u4")
                n = len(ids)
                raw = ids.tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    take = min(length - offset, n - start)
                    piece = raw[4 * start : 4 * (start + take)]
                    for column, value in zip(rows, (doc_id, start, take, piece, zlib.crc32(piece), n, sequence, offset)):
                        column.append(value)
                    start += take
            flat = pa.array(np.frombuffer(b"".join(rows[3]), "<u4").astype(np.int32))
            ends = pa.array(np.cumsum([0, *rows[2]]), pa.int32())
            longs = [pa.array(rows[i], pa.int64()) for i in (1, 2, 4, 5, 6, 7)]
            arrays = [pa.array(rows[0], batch.schema.field(0).type), longs[0], longs[1], pa.ListArray.from_arrays(ends, flat), *longs[2:]]
            yield pa.RecordBatch.from_arrays(arrays, NAMES)

    assert itemsize in (2, 4)
    return placed.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


NAMES = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary_path()).drop("ids")
