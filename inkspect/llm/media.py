"""Media columns: text bytes stored as lossless WebP images and read back."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import webp
from .common import documents, ids_and_text, slices

ROW = 192
FRAME = ROW * webp.LARGEST_SIDE  # bytes of the largest image of this width


def store(data: bytes) -> bytes:
    """``data`` padded with blanks to a positive multiple of 192, as one or more WebP files one after another."""
    payload = data + b" " * (-len(data) % ROW if data else ROW)
    parts = (np.frombuffer(payload[i : i + FRAME], np.uint8).reshape(-1, ROW) for i in range(0, len(payload), FRAME))
    return b"".join(map(webp.encode_samples, parts))


def frames(media: bytes) -> list[np.ndarray]:
    """The sample arrays of a stored form."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(((webp.decode(media[at:end]) >> 8) & 255).astype(np.uint8))
        at = end
    return out


def feature(samples: np.ndarray) -> str:
    """Size, values and texture of a sample array, in whole numbers."""
    counts = np.bincount(samples.reshape(-1), minlength=256)
    levels = np.arange(256)
    total, squares = int(counts @ levels), int(counts @ levels**2)
    across = int(np.abs(np.diff(samples.astype(np.int16), axis=1)).sum())
    return f"rows={len(samples)} distinct={int((counts > 0).sum())} mode={int(counts.argmax())} sum={total} squares={squares} across={across}"


def read_pixels(media: DataFrame, column: str = "media") -> DataFrame:
    """(key columns..., width, height, argb binary) of a column of WebP files; null where a file can't be read."""
    at = media.columns.index(column)
    rest = [f for f in media.schema.fields if f.name != column]

    def run(batches):
        for batch in batches:
            found = []
            for data in batch.column(at).to_pylist():
                try:
                    found.append(webp.decode(data or b""))
                except (ValueError, IndexError, TypeError, struct.error):
                    found.append(None)
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            sides = [pa.array([None if x is None else x.shape[i] for x in found], pa.int32()) for i in (1, 0)]
            yield pa.RecordBatch.from_arrays([*kept, *sides, pa.array([None if x is None else x.astype("<u4").tobytes() for x in found], pa.binary())], [*(f.name for f in rest), "width", "height", "argb"])

    pixels = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("argb", T.BinaryType())]
    return media.mapInArrow(run, T.StructType([*rest, *pixels]))


def store_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the stored form of each whole text; null is empty."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([store((t or "").encode()) for t in part.column(1).to_pylist()], pa.binary())], ["doc_id", "media"])

    return ids_and_text(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, media binary")


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(data: bytes) -> tuple:
    media = store(data)
    samples = np.concatenate(frames(media))
    payload = samples.tobytes()
    return (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples))


def stored_and_read(docs: DataFrame) -> DataFrame:
    """Store each text, read the stored bytes back, and describe both.

    Null and empty texts are one row of blanks.  Rows are independent: repeated rows
    give repeated rows, an empty table none.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                rows = [describe((t or "").encode()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", *names])

    return ids_and_text(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {COLUMNS}")


def op10_media(spark, sf_dir: str) -> DataFrame:
    return stored_and_read(documents(spark, sf_dir))
