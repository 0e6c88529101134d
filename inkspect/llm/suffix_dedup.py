"""Suffix-array dedup: distributed prefix doubling over a lossless sample of positions.

Every position of every text is a suffix; it repeats if its first ``LENGTH`` = 50
bytes also start in a smaller document.  Ranks of prefixes grow by doubling: the
rank of 2k bytes at p is made of the ranks of k bytes at p and at p + k.  The
ranks are fingerprints that any executor computes alike, so inside a text the
doubling needs no exchange; what has to be exchanged is which ranks are held
elsewhere, and that is sorted by rank in buckets, a round each:

1. 24 bytes.  Of the 27 strings of 24 bytes inside a 50-byte string the one with
   the least rank is its anchor.  Equal 50-byte strings have equal anchors at
   equal places, so anchors alone (one position in fourteen) are ranked; what is
   unique at 24 bytes is unique at 50 and is settled.
2. 50 to 76 bytes.  All 50-byte strings that share an anchor are one run of
   positions.  Where an anchor's rank is repeated, runs are ranked whole by the
   pair of ranks at their two ends.  If all runs of an anchor's rank have one rank,
   every position in them is settled.
3. 50 bytes.  The positions of the runs that remain are ranked one by one.

No position is dropped but one that is unique or settled, so the result is that
of ranking every suffix.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks
from .blocks import mix
from .common import documents, materialise, slices, text_bytes

LENGTH, GRAM = 50, 24
REACH = LENGTH - GRAM + 1  # strings of GRAM bytes in one of LENGTH
BYTES = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0xA0761D6478BD642F)
#: Replied for an anchor whose runs differ.
MIXED = np.iinfo(np.int64).min


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def doubled(rank: np.ndarray, tail: np.ndarray, k: int, n: int) -> np.ndarray:
    """Ranks of k + n bytes from those of k bytes and, k places on, of n bytes."""
    out = rank * power(n)
    if len(out) > k:
        out[:-k] += tail[k:]
    return out


def ranks(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of 24 and of 32 bytes at every place; those that run past the end are of no use."""
    by = {1: BYTES[raw]}
    for k in (1, 2, 4, 8, 16):
        by[2 * k] = doubled(by[k], by[k], k, k)
    return mix(doubled(by[16], by[8], 16, 8)), by[32]


def fifty(r32: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Ranks of 50 bytes at ``p``: the pair of those of 32 bytes at p and at p + 18."""
    return mix(r32[p] * BASE + mix(r32[p + LENGTH - 32]))


class Runs:
    """The runs of a block's texts, as arrays of one length.

    row: the text; at: its first place in the text; count: its places; anchor: the
    anchor's rank; rank: that of the whole run; part, low: where its bytes are ranked.
    """

    def __init__(self, column: pa.ChunkedArray):
        self.ranked, found = [], []
        for a, b in slices(column, 1 << 20):
            raw, offsets = text_bytes(column.slice(a, b - a))
            if len(raw) >= LENGTH:
                found.append(self._of(raw, offsets, a))
        none = np.empty(0, np.int64)
        self.part, self.row, self.at, self.low, self.count, self.anchor, self.rank = (
            (np.concatenate(x) for x in zip(*found)) if found else (*[none] * 5, *[none.astype(np.uint64)] * 2)
        )

    def _of(self, raw: np.ndarray, offsets: np.ndarray, first_row: int) -> tuple:
        r24, r32 = ranks(raw)
        self.ranked.append(r32)
        n, byte = len(raw), np.uint64(8)
        key, span = (r24 >> byte) << byte, 1  # the low byte counts places to the right, so the leftmost wins a tie
        while 2 * span <= REACH:
            key[: n - span] = np.minimum(key[: n - span], key[span:] + np.uint64(span))
            span *= 2
        rest = REACH - span
        key[: n - rest] = np.minimum(key[: n - rest], key[rest:] + np.uint64(rest))
        counts = np.maximum(0, np.diff(offsets) - LENGTH + 1)
        row = np.repeat(np.arange(len(counts)), counts)
        p = np.arange(len(row)) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)  # all places with 50 bytes
        owner = p + (key[p] & np.uint64(255)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(p)), bool), (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])]))
        last = np.concatenate([first[1:], [len(p)]])[: len(first)] - 1
        low, high, own = p[first], p[last], owner[first]
        shape = ((high - low) * 64 + own - low).astype(np.uint64)
        rank = mix(fifty(r32, low) * BASE + mix(fifty(r32, high) + shape))
        part = np.full(len(first), len(self.ranked) - 1)
        return part, row[first] + first_row, low - offsets[row[first]], low, high - low + 1, r24[own], rank

    def places(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run, rank of 50 bytes) of every place of the chosen runs, in order."""
        count = self.count[chosen]
        run = np.repeat(chosen, count)
        inside = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        out = np.empty(len(run), np.uint64)
        part, low = self.part[run], self.low[run] + inside
        for i, r32 in enumerate(self.ranked):
            own = part == i
            out[own] = fifty(r32, low[own])
        return run, out


def repeated_elsewhere(columns: list[np.ndarray], source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Round 1: the entries whose rank several blocks hold."""
    _, inverse, counts = np.unique(columns[0], return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    return again, np.zeros(len(again), np.int64)


def first_or_mixed(columns: list[np.ndarray], source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Round 2: entries of anchors whose runs differ, and entries that a smaller document beats."""
    anchor, rank, doc = columns
    order = np.lexsort([rank, anchor])
    a, r = anchor[order], rank[order]
    new = np.concatenate([[True], a[1:] != a[:-1]])
    group = np.cumsum(new) - 1
    differs = np.zeros(group[-1] + 1, bool)
    differs[group[1:][(a[1:] == a[:-1]) & (r[1:] != r[:-1])]] = True
    mixed = np.empty(len(a), bool)
    mixed[order] = differs[group]
    picked, value = blocks.first_holder(columns, source)
    alone = ~mixed[picked]
    several = np.flatnonzero(mixed)
    return np.concatenate([several, picked[alone]]), np.concatenate([np.full(len(several), MIXED), value[alone]])


class Rounds:
    """What a block knows after the replies to each round; every call derives it from the block's texts alone."""

    def __init__(self, table: pa.Table, replies: pa.Table | None, buckets: int):
        self.replies, self.buckets = replies, buckets
        self.runs, self.doc = Runs(table.column("text")), blocks.doc_keys(table.column("doc_id"))

    def anchors(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        return blocks.distinct([self.runs.anchor], self.doc[self.runs.row])

    def whole_runs(self):
        """Distinct (anchor, rank) of the runs whose anchor is held twice; and those runs."""
        keys, _, place = self.anchors()
        again = np.bincount(place, minlength=len(keys[0])) > 1
        again[blocks.replied(self.replies, 1, keys[0], self.buckets)[0]] = True
        self.chosen = np.flatnonzero(again[place]) if len(place) else place
        return blocks.distinct([self.runs.anchor[self.chosen], self.runs.rank[self.chosen]], self.doc[self.runs.row[self.chosen]])

    def single_places(self):
        """Distinct (rank of 50 bytes, low half of the anchor's rank: 96 bits) of the places of mixed runs; settles the others."""
        keys, least, place = self.whole_runs()
        holder = least.copy()
        position, value = blocks.replied(self.replies, 2, keys[0], self.buckets)
        holder[position] = value
        mixed = holder[place] == MIXED if len(place) else np.empty(0, bool)
        self.settled = self.chosen[~mixed][holder[place][~mixed] < self.doc[self.runs.row[self.chosen[~mixed]]]]
        self.run, rank = self.runs.places(self.chosen[mixed])
        return blocks.distinct([rank, self.runs.anchor[self.run].astype(np.uint32)], self.doc[self.runs.row[self.run]])

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end) of stretches that start in smaller documents too."""
        keys, least, place = self.single_places()
        holder = least.copy()
        position, value = blocks.replied(self.replies, 3, keys[0], self.buckets)
        holder[position] = value
        hit = holder[place] < self.doc[self.runs.row[self.run]] if len(place) else np.empty(0, bool)
        count = self.runs.count[self.run]
        first = np.concatenate([[True], self.run[1:] != self.run[:-1]])[: len(self.run)]
        starts = np.flatnonzero(first)
        inside = np.arange(len(self.run)) - np.repeat(starts, count[starts])
        at = (self.runs.at[self.run] + inside)[hit]
        row = np.concatenate([self.runs.row[self.settled], self.runs.row[self.run][hit]])
        start = np.concatenate([self.runs.at[self.settled], at])
        end = np.concatenate([self.runs.at[self.settled] + self.runs.count[self.settled] - 1, at]) + LENGTH
        order = np.argsort(row, kind="stable")
        return row[order], start[order], end[order]


def dedup_suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    A byte goes if a string of 50 bytes that covers it also starts in a document
    with a smaller id; strings are judged on the input, and matches never cross
    documents.  Null and empty texts, and those under 50 bytes, are kept.  Rows
    that share an id don't remove from each other; a null id comes after all.
    What is kept is binary: a cut may fall inside a character.
    """
    layout = blocks.Layout(docs)
    buckets = layout.buckets

    def ask_anchors(key, table):
        keys, *_ = Rounds(table, None, buckets).anchors()
        return blocks.requests(key[0].as_py(), 1, buckets, keys, None)

    def ask_runs(key, table, replies):
        keys, least, _ = Rounds(table, replies, buckets).whole_runs()
        return blocks.requests(_block(table), 2, buckets, keys, least)

    def ask_places(key, table, replies):
        keys, least, _ = Rounds(table, replies, buckets).single_places()
        return blocks.requests(_block(table), 3, buckets, keys, least)

    def cut(key, table, replies):
        row, start, end = Rounds(table, replies, buckets).repeated()
        bounds, out = np.searchsorted(row, np.arange(table.num_rows + 1)), [[] for _ in range(5)]
        for i, text in enumerate(table.column("text").to_pylist()):
            data, (a, b), spans = (text or "").encode(), bounds[i : i + 2], 0
            kept = data
            if b > a:
                stays = blocks.kept_ranges(len(data), start[a:b], end[a:b])
                kept = np.frombuffer(data, np.uint8)[stays].tobytes()
                spans = int((np.diff(np.concatenate([[True], stays]).astype(np.int8)) == -1).sum())
            for column, x in zip(out, (kept, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())):
                column.append(x)
        kinds = [pa.binary(), *[pa.int64()] * 3, pa.string()]
        return pa.table([table.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def both(replies, f, schema):
        return layout.grouped().cogroup(replies.groupBy("block")).applyInArrow(f, schema)

    asked = layout.grouped().applyInArrow(ask_anchors, blocks.REQUEST)
    replies = materialise(blocks.answer(asked, ["<u8"], repeated_elsewhere), "suffix-24")
    asked = both(replies, ask_runs, blocks.REQUEST)
    replies = replies.unionByName(materialise(blocks.answer(asked, ["<u8", "<u8", "<i8"], first_or_mixed), "suffix-runs"))
    asked = both(replies, ask_places, blocks.REQUEST)
    replies = replies.unionByName(materialise(blocks.answer(asked, ["<u8", "<u4", "<i8"], blocks.first_holder), "suffix-50"))
    return both(replies, cut, f"doc_id {dict(docs.dtypes)['doc_id']}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _block(table: pa.Table) -> int:
    return table.column("block")[0].as_py() if table.num_rows else -1


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_suffixes(documents(spark, sf_dir)).drop("kept")
