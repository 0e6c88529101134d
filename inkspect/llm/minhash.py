"""MinHash near-dedup with circulant signatures.

Two permutations make a whole signature: the first deals shingles to places of a ring
of 2^32, the second, turned by one place more for each coordinate, orders them, and a
coordinate is the least of what the turned permutation gives to a set's places.  Bands
of a few coordinates are hashed to keys; texts with the same set are one node, and
nodes that share two keys or more are candidates.

Candidates are confirmed on full sets, as in ``near_copies``: first each key's sets with
its leader, then by their differences from it.  A pair over the threshold is missed by
the bands with a probability of 2e-9 at most (50 bands of 6 coordinates, a similarity
of 0.85), and no other step loses one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import mix
from .common import documents
from .near_copies import Likeness, _named

#: Places that are worked on at once: 32 bits each, so that they stay in a core's cache.
PLACES = 1 << 14


def permuted(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of 32-bit numbers, in place: odd multipliers and shifts."""
    t = x >> np.uint32(16)
    x ^= t
    x *= np.uint32(first)
    np.right_shift(x, np.uint32(15), out=t)
    x ^= t
    x *= np.uint32(second)
    np.right_shift(x, np.uint32(16), out=t)
    x ^= t
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """The circulant MinHash of each set of 64-bit hashes (one at least in each), a row a set."""
    places = permuted((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    starts = np.cumsum([0, *map(len, sets)])
    least = np.full((coordinates, len(sets)), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(places), PLACES):
        own = places[at : at + PLACES]
        first, end = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, at + len(own), "left")
        cuts = np.maximum(starts[first:end] - at, 0)  # many sets at once, or a part of one
        for k in range(coordinates):
            of = least[k, first:end]
            np.minimum(of, np.minimum.reduceat(permuted(own + np.uint32(k), 0x21F0AAAD, 0xD35A2D97), cuts), out=of)
    return least.T


class Bands:
    """A set's keys as its only cut: one for each band; similar sets share two or more."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows

    def __call__(self, sets: list[np.ndarray]) -> list[list[tuple[int, int, np.ndarray]]]:
        there = [h for h in sets if len(h)]
        if not there:
            return [[] for _ in sets]
        of = signatures(there, self.bands * self.rows).reshape(len(there), self.bands, self.rows).astype(np.uint64)
        key = np.tile(np.arange(1, self.bands + 1, dtype=np.uint64), (len(there), 1))
        for i in range(self.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + of[:, :, i])
        keys = iter(key >> np.uint64(16))  # 48 bits take less room
        return [[(0, 2, next(keys))] if len(h) else [] for h in sets]


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85, bands: int = 50, rows: int = 6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    A document's set are its different shingles of ``size`` words, with A-Z lower-cased; with
    fewer words the whole sequence is one.  Documents with a Jaccard similarity of ``percent``
    in a hundred or more are linked; component_id is the smallest doc_id reachable, and the
    row whose id that is, is kept.

    Null text is empty; texts without words are linked with nothing.  Null ids take part but
    never name a component unless it has no other id.  Repeated rows are repeated.  Other
    columns don't matter.  An empty table gives no row.
    """
    found = _named(docs, size, Bands(bands, rows), Likeness(percent, 100), prints=False)[0]
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    named = found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
