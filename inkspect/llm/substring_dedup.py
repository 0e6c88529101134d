"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text (each byte's random number, shifted
once a byte, sixteen bytes deep).  A text is cut after every place where the hash
is less than at the ``reach`` places on both sides, so cuts depend on nearby bytes
only and come back a few bytes after an insertion.  Chunks are compared by a
128-bit digest.  A chunk that a document with a smaller id holds too is repeated;
runs of repeated chunks of ``least`` bytes or more are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import blocks
from .common import documents, fields, ids_and_text, materialise, slices, text_bytes

GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
DEPTH, LONGEST = 16, 1024


def cuts(raw: np.ndarray, offsets: np.ndarray, reach: int) -> np.ndarray:
    """Starts of all chunks of the texts in ``raw`` and its size, in order; every text starts a chunk."""
    n = len(raw)
    starts = [offsets[:-1][np.diff(offsets) > 0]]
    if n > 2 * reach + DEPTH:
        h = GEAR[raw]
        for k in (1, 2, 4, 8):  # DEPTH bytes back
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        least, span = h.copy(), 1  # least of h[p : p + reach]
        while span < reach:
            step = min(span, reach - span)
            least[: n - step] = np.minimum(least[: n - step], least[step:])
            span += step
        p = np.arange(DEPTH + reach - 1, n - reach - 1)
        p = p[(h[p] < least[p - reach]) & (h[p] < least[p + 1])]
        doc = np.searchsorted(offsets, p, "right") - 1
        p = p[(p - offsets[doc] >= DEPTH + reach - 1) & (offsets[doc + 1] - p > reach + 1)] + 1
        for _ in range(3):  # never inside a character
            p = p + ((raw[p] & 0xC0) == 0x80)
        starts.append(p)
    own = np.unique(np.concatenate([*starts, [n]])).astype(np.int64)
    if len(own) > 1 and np.diff(own).max() > LONGEST:  # stretches without a least place, such as one repeated byte
        more = []
        for a, b in zip(own[:-1], own[1:]):
            p = np.arange(a + LONGEST, b, LONGEST)
            for _ in range(3):
                p = p + ((raw[np.minimum(p, n - 1)] & 0xC0) == 0x80) if len(p) else p
            more.append(p[p < b])
        own = np.unique(np.concatenate([own, *more]))
    return own


def chunks(column: pa.ChunkedArray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in the text, end, digest as two 64-bit columns) of all chunks."""
    rows, starts, ends, digests = [], [], [], []
    for a, b in slices(column):
        raw, offsets = text_bytes(column.slice(a, b - a))
        own, data = cuts(raw, offsets, reach), raw.tobytes()
        if len(own) < 2:
            continue
        digests.append(b"".join([xxhash.xxh3_128_digest(data[i:j]) for i, j in zip(own[:-1].tolist(), own[1:].tolist())]))
        row = np.searchsorted(offsets, own[:-1], "right") - 1
        rows.append(row + a)
        starts.append(own[:-1] - offsets[row])
        ends.append(own[1:] - offsets[row])
    if not rows:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty((0, 2), np.uint64)
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(ends), np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _asked(table: pa.Table, reach: int):
    row, start, end, digest = chunks(table.column("text"), reach)
    doc = blocks.doc_keys(table.column("doc_id"))
    keys, least, place = blocks.distinct([digest[:, 0], digest[:, 1]], doc[row])
    return row, start, end, doc, keys, least, place


def removals(size: int, start: np.ndarray, end: np.ndarray, repeated: np.ndarray, least: int) -> np.ndarray:
    """Kept bytes of a text of ``size``, given its chunks in order and which are repeated."""
    edge = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    a, b = start[first], end[last]
    long = b - a >= least
    return blocks.kept_ranges(size, a[long], b[long])


def dedup_substrings(docs: DataFrame, reach: int = 16, least: int = 64, carry: bool = False) -> DataFrame:
    """(doc_id, kept_text, n_bytes, n_chunks, n_removed, n_spans, kept_sha256) for every row; with ``carry`` also rest.

    n_removed counts bytes, n_spans the stretches removed.  The document with the
    smallest id keeps a repeated stretch; rows that share an id don't remove from
    each other, and what repeats inside one document stays.  A null id comes after
    all others.  Null and empty texts have no chunk.
    """
    layout = blocks.Layout(docs)

    def ask(key, table):
        *_, keys, smallest, _ = _asked(table, reach)
        return blocks.requests(key[0].as_py(), 0, layout_buckets, keys, smallest)

    layout_buckets = layout.buckets
    asked = layout.grouped().applyInArrow(ask, blocks.REQUEST)
    replies = materialise(blocks.answer(asked, ["<u8", "<u8", "<i8"], blocks.first_holder), "chunk-replies")

    def cut(key, table, reply):
        row, start, end, doc, keys, smallest, place = _asked(table, reach)
        position, value = blocks.replied(reply, 0, keys[0], layout_buckets)
        holder = smallest.copy()
        holder[position] = value
        repeated = holder[place] < doc[row]
        bounds = np.searchsorted(row, np.arange(len(doc) + 1))
        out = [[] for _ in range(6)]
        for i, text in enumerate(table.column("text").to_pylist()):
            data, (a, b) = (text or "").encode(), bounds[i : i + 2]
            kept, spans = data, 0
            if repeated[a:b].any():
                stays = removals(len(data), start[a:b], end[a:b], repeated[a:b], least)
                kept = np.frombuffer(data, np.uint8)[stays].tobytes()
                spans = int((np.diff(np.concatenate([[True], stays]).astype(np.int8)) == -1).sum())
            values = (kept.decode(), len(data), int(b - a), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())
            for column, x in zip(out, values):
                column.append(x)
        kinds = [pa.string(), *[pa.int64()] * 4, pa.string()]
        columns = [table.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds))]
        names = ["doc_id", "kept_text", "n_bytes", "n_chunks", "n_removed", "n_spans", "kept_sha256"]
        return pa.table([*columns, *([table.column("rest")] if rest else [])], names=[*names, *(["rest"] if rest else [])])

    held = ids_and_text(docs, carry)
    rest = [held.schema["rest"]] if "rest" in held.columns else []
    schema = fields(docs, "kept_text string, n_bytes long, n_chunks long, n_removed long, n_spans long, kept_sha256 string", *rest)
    return layout.grouped(carry).cogroup(replies.groupBy("block")).applyInArrow(cut, schema)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir)).drop("kept_text")
