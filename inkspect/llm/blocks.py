"""Which document is the first to hold a fingerprint, asked in blocks.

Documents are dealt to blocks by a hash of their id, a block being a few MB of
text.  A block asks once about each of its different fingerprints: it sends,
per bucket of the fingerprint space, one row with the sorted fingerprints and the
smallest document of the block that holds each.  A bucket merges what the blocks
sent and replies, per block, with the positions for which another block knows
more.  So a fingerprint that a third of all documents hold travels once a block,
and neither a block nor a bucket grows with the hottest key.

Block size grows with the square root of the input up to ``LARGEST``; rows
between blocks and buckets are never more than the fingerprints themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text

SMALLEST, LARGEST, LEAST_BLOCKS = 2 << 20, 32 << 20, 128
#: Stands for a null id: after every other document.
LAST = np.iinfo(np.int64).max

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * _C2
    x ^= x >> np.uint64(29)
    x = x * _C1
    return x ^ (x >> np.uint64(32))


class Layout:
    """Blocks and buckets for a table of documents."""

    def __init__(self, docs: DataFrame):
        total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
        size = min(LARGEST, max(SMALLEST, int(math.sqrt(total / 1e6) * 7e4)))
        self.blocks = max(LEAST_BLOCKS, math.ceil(total / size))
        self.buckets = max(LEAST_BLOCKS, min(self.blocks, math.ceil(total / SMALLEST)))
        self.docs = docs

    def grouped(self, carry: bool = False):
        """The documents by block: (block, doc_id, text), and rest if it is carried."""
        rows = ids_and_text(self.docs, carry)
        return rows.select(F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(self.blocks)).alias("block"), *rows.columns).groupBy("block")


def doc_keys(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(LAST)).to_numpy().astype(np.int64)


def distinct(keys: list[np.ndarray], doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(different key tuples in order, smallest document of each, place of every input row among them)."""
    if not len(doc):
        return keys, doc, np.empty(0, np.int64)
    order = np.lexsort([doc, *reversed(keys)])
    sorted_keys = [k[order] for k in keys]
    new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])])
    starts, place = np.flatnonzero(new), np.empty(len(doc), np.int64)
    place[order] = np.cumsum(new) - 1
    return [k[starts] for k in sorted_keys], doc[order][starts], place


REQUEST = REPLY = "block long, bucket long, kind int, data binary"


def dealt(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in order of bucket, the buckets there are, where each begins and the end)."""
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    there, first = np.unique(bucket[order], return_index=True)
    return order, there, np.concatenate([first, [len(order)]])


def requests(block: int, kind: int, buckets: int, keys: list[np.ndarray], doc: np.ndarray | None) -> pa.Table:
    """A row per bucket for distinct() output; an entry is known by its place in the row, which both sides can work out."""
    order, there, cuts = dealt(keys[0], buckets)
    columns = [k[order] for k in (*keys, *([] if doc is None else [doc]))]
    blobs = [pack([c[a:b] for c in columns]) for a, b in zip(cuts, cuts[1:])]
    n = len(there)
    return pa.table({"block": pa.array([block] * n, pa.int64()), "bucket": pa.array(there, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "data": pa.array(blobs, pa.binary())})


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns one after another, each by byte planes: planes of ids and positions are mostly zero or slow, and shuffle small."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


def unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(blob) // sum(sizes), [], 0
    for kind, size in zip(kinds, sizes):
        planes = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * size
    return out


def answer(asked: DataFrame, kinds: list[str], merge: Callable[[list[np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Replies (block, bucket, kind, data): places and values for the entries that ``merge`` picks.

    merge(columns, source) gets a bucket's entries, with the block that sent each,
    and returns (entry numbers, one int64 each).
    """

    def run(table):
        blocks, kind, bucket = table.column("block").to_numpy(), table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        parts = [unpack(x.as_buffer(), kinds) for x in table.column("data")]
        sizes = np.array([len(p[0]) for p in parts])
        source, place = np.repeat(np.arange(len(parts)), sizes), np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])
        columns = [np.concatenate(c) for c in zip(*parts)]
        picked, value = merge(columns, source)
        order = np.lexsort([picked, source[picked]])
        picked, value = picked[order], value[order]
        cuts = np.searchsorted(source[picked], np.arange(len(parts) + 1))
        rows = [(int(blocks[i]), pack([place[picked[a:b]], value[a:b]])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        n = len(rows)
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([bucket] * n, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, REPLY)


def first_holder(columns: list[np.ndarray], source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """merge for (key, key, ..., doc): entries that another block's smaller document beats, with that document."""
    *keys, doc = columns
    _, least, place = distinct(keys, doc)
    beaten = np.flatnonzero(least[place] < doc)
    return beaten, least[place][beaten]


def replied(replies: pa.Table | None, kind: int, key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in distinct() output, values) of a block's replies of one kind."""
    positions, values = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if replies is not None and replies.num_rows:
        order, there, cuts = dealt(key, buckets)
        begins = dict(zip(there.tolist(), cuts.tolist()))
        for k, bucket, data in zip(replies.column("kind").to_pylist(), replies.column("bucket").to_pylist(), replies.column("data")):
            if k == kind:
                place, value = unpack(data.as_buffer(), ["<u4", "<i8"])
                positions.append(order[begins[bucket] + place])
                values.append(value)
    return np.concatenate(positions), np.concatenate(values)


def kept_ranges(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for the bytes of ``size`` that no [start, end) covers."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) == 0
