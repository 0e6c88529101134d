"""Phrase collocation mining: candidates by a sketch, counted by automata, scored exactly.

Texts are brought into a plain form (words with one space between, a line feed as a
word of its own where pieces end) and written once as shards, each a few MB of one
language.  A shard works out its different phrases and adds them to a counting sketch
of one row: a phrase is a cell, and a cell's count bounds that of every phrase in it
from above.  The sketch is dealt by ranges of cells, as wide as the corpus needs, to
buckets; a shard sends each bucket its cells in one row, and gets one bit for each
back: whether the bound reaches the threshold.  So neither a task nor the driver holds
the sketch, and a phrase that all documents have travels once a shard.

The phrases of a shard that the bounds leave compile into an automaton, each with a
space on both sides as its guard, and a scan of the shard counts all matches,
overlapping ones too; single words, which scores need, are counted as they are.  Sums over
shards are exact, since a phrase over the threshold is in the automaton of every
shard that has it, and those under it are dropped then.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import mix, pack, unpack
from .common import discard, documents, materialise, plain_text

END = "\n"
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 10)
ENDS = re.compile(rb"\n(?: \n)+")
#: Bytes of a shard, and of all shards that a task is filling.
SHARD, FILLING = 8 << 20, 64 << 20
#: Cells for each phrase of a text; phrases of the largest bucket while there are fewer than MOST_BUCKETS.
CELLS, BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 4, 4_000_000, 128, 1 << 18


def plain(text: str) -> bytes:
    """Words with A-Z lower-cased and a space between; a line feed ends each piece."""
    data = text.encode().translate(PLAIN).replace(b"\n", b" \n ")
    return ENDS.sub(b"\n", b" ".join([w for w in data.split(b" ") if w] + [b"\n"]))


def shards(docs: DataFrame, part: str, shard_bytes: int = SHARD) -> DataFrame:
    """(shard, part, words, text): the plain texts, written in pieces of one part and about ``shard_bytes``."""

    def run(batches):
        filling: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def full(name):
            text, _ = b" ".join(filling.pop(name)), sizes.pop(name)
            words = text.count(b" ") + 1 - text.count(b"\n")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([words], pa.int64()), pa.array([text.decode()])], ["part", "words", "text"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = plain(text.as_py())
                filling.setdefault(name, []).append(data)
                sizes[name] = sizes.get(name, 0) + len(data) + 1
                if sizes[name] >= shard_bytes:
                    yield full(name)
                if sum(sizes.values()) >= FILLING:
                    yield full(max(sizes, key=sizes.get))
        for name in list(filling):
            yield full(name)

    rows = docs.select(F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("und")).alias("part"), plain_text().alias("text"))
    made = rows.mapInArrow(run, "part string, words long, text string").withColumn("shard", F.monotonically_increasing_id())
    return materialise(made.where("words > 0"), "shards")


class Phrases:
    """The different phrases of a shard, of one word, two words and so on, and a hash of each."""

    def __init__(self, part: str, text: str, most: int):
        tokens = pc.split_pattern(pa.array([text], pa.large_string()), " ").values.dictionary_encode()
        ids, self.words = tokens.indices.to_numpy().astype(np.int64), tokens.dictionary.to_pylist()
        self.size = len(self.words)
        ids[ids == self.words.index(END) if END in self.words else np.zeros(len(ids), bool)] = -1
        salt = part.encode() + b"\0"
        one = np.array([xxhash.xxh64_intdigest(salt + w.encode()) for w in self.words], np.uint64)
        self.keys, self.hashes, self.counts = [], [], []
        longer = ids
        for n in range(1, most + 1):
            if n > 1:
                longer = np.where((longer[:-1] >= 0) & (ids[n - 1 :] >= 0), longer[:-1] * self.size + ids[n - 1 :], -1)
            codes, keys = pd.factorize(longer)
            if len(there := np.flatnonzero(keys < 0)):  # no phrase: its code becomes -1, later ones move up
                codes = np.where(codes == there[0], -1, codes - (codes > there[0]))
                keys = np.delete(keys, there[0])
            self.keys.append(keys)
            self.counts.append(np.bincount(codes[codes >= 0], minlength=len(keys)))
            self.hashes.append(one[keys] if n == 1 else mix(self.hashes[-1][keys // self.size] * np.uint64(0x9E3779B97F4A7C15) + one[keys % self.size]))
            longer = codes

    def texts(self, n: int, of: np.ndarray) -> list[str]:
        """Some of the phrases of n words, by their numbers."""
        words, parts = pa.array(self.words, pa.large_string()), []
        for keys in self.keys[n - 1 : 0 : -1]:
            parts.append(keys[of] % self.size)
            of = keys[of] // self.size
        parts.append(self.keys[0][of])
        return pc.binary_join_element_wise(*(words.take(pa.array(p)) for p in reversed(parts)), pa.scalar(" ", pa.large_string())).to_pylist()


class Sketch:
    """Ranges of cells; what a shard sends each of them."""

    def __init__(self, words: int, most: int, least: int):
        phrases = max(1, words * most)
        self.buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, math.ceil(phrases / BUCKET)))
        self.cells, self.least = math.ceil(CELLS * phrases / self.buckets), least
        self.count = "<u1" if least <= 255 else "<u4"

    def cells_of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(different cells in order, order of the hashes, where in it each cell begins); a cell's number holds its bucket."""
        bucket = hashes % np.uint64(self.buckets)
        cell = bucket * np.uint64(self.cells) + hashes // np.uint64(self.buckets) % np.uint64(self.cells)
        order = np.argsort(cell, kind="stable")
        sorted_ = cell[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        return sorted_[first], order, first

    def by_bucket(self, cells: np.ndarray) -> list[tuple[int, int, int]]:
        """(bucket, start, end) of cells in order."""
        bucket = (cells // np.uint64(self.cells)).astype(np.int64)
        there, first = np.unique(bucket, return_index=True)
        return list(zip(there.tolist(), first.tolist(), [*first[1:].tolist(), len(cells)]))

    def requests(self, table: DataFrame, most: int) -> DataFrame:
        """(shard, bucket, data): the cells of each shard and the counts in it, as far as the threshold."""

        def run(batches):
            for batch in batches:
                for shard, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    own = Phrases(part, text.as_py(), most)
                    cells, order, first = self.cells_of(np.concatenate(own.hashes))
                    counts = np.minimum(np.add.reduceat(np.concatenate(own.counts)[order], first), self.least).astype(self.count)
                    rows = [(bucket, pack([np.diff(cells[a:b] - np.uint64(bucket * self.cells), prepend=np.uint64(0)).astype("<u4"), counts[a:b]])) for bucket, a, b in self.by_bucket(cells)]
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int64()), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary())], ["shard", "bucket", "data"])

        return table.select("shard", "part", "text").mapInArrow(run, "shard long, bucket long, data binary")

    def answers(self, requests: DataFrame) -> DataFrame:
        """(shard, bucket, data): a bit for each cell asked about, whether it reaches the threshold; no row where none does."""

        def run(table):
            asked = [unpack(x.as_buffer(), ["<u4", self.count]) for x in table.column("data")]
            bound = np.zeros(self.cells, np.int64)
            at = [np.cumsum(delta, dtype=np.int64) for delta, _ in asked]
            for cells, (_, counts) in zip(at, asked):
                bound[cells] += counts
            reached = bound >= self.least
            rows = [(shard, np.packbits(bits).tobytes()) for shard, bits in zip(table.column("shard").to_pylist(), (reached[cells] for cells in at)) if bits.any()]
            bucket = table.column("bucket")[0].as_py()
            return pa.table({"shard": pa.array([x[0] for x in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int64()), "data": pa.array([x[1] for x in rows], pa.binary())})

        return requests.groupBy("bucket").applyInArrow(run, "shard long, bucket long, data binary")

    def left(self, own: Phrases, replies: dict[int, bytes]) -> list[np.ndarray]:
        """The phrases of a shard that the bounds leave, by their numbers: of one word, of two and so on."""
        cells, order, first = self.cells_of(np.concatenate(own.hashes))
        reached = np.zeros(len(cells), bool)
        for bucket, a, b in self.by_bucket(cells):
            if bucket in replies:
                reached[a:b] = np.unpackbits(np.frombuffer(replies[bucket], np.uint8), count=b - a)
        keep = np.zeros(len(order), bool)
        keep[order] = np.repeat(reached, np.diff(np.append(first, len(order))))
        ends = np.cumsum([0, *map(len, own.hashes)])
        return [np.flatnonzero(keep[a:b]) for a, b in zip(ends, ends[1:])]


def matches(text: str, phrases: list[str]) -> np.ndarray:
    """How often each phrase is in a plain text, overlapping matches counted."""
    if not phrases:
        return np.empty(0, np.int64)
    automaton = ahocorasick.Automaton()
    for i, phrase in enumerate(phrases):
        automaton.add_word(f" {phrase} ", i)
    automaton.make_automaton()
    return np.bincount(np.fromiter((i for _, i in automaton.iter(f" {text} ")), np.int64), minlength=len(phrases))


def phrase_counts(table: DataFrame, words: int, most: int, least: int) -> DataFrame:
    """(part, phrase, f): all phrases of up to ``most`` words that are there ``least`` times or more."""
    sketch = Sketch(words, most, least)
    replies = materialise(sketch.answers(sketch.requests(table, most)), "sketch-bounds")

    def scan(left, right):
        out = []
        for part, text in zip(left.column("part").to_pylist(), left.column("text")):
            replies = dict(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist()))
            own = Phrases(part, text.as_py(), most)
            one, *several = sketch.left(own, replies)
            phrases = [x for n, of in enumerate(several, 2) for x in own.texts(n, of)]
            counts = np.concatenate([own.counts[0][one], matches(text.as_py(), phrases)])
            phrases = own.texts(1, one) + phrases
            out.append(pa.table({"part": pa.array([part] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.string()), "f": pa.array(counts, pa.int64())}))
        return pa.concat_tables(out) if out else pa.table({"part": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "f": pa.array([], pa.int64())})

    found = table.select("shard", "part", "text").groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(scan, "part string, phrase string, f long")
    counts = materialise(found.groupBy("part", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrases")
    discard(replies)
    return counts


def scored(counts: DataFrame, most: int, inside_percent: int = 50) -> DataFrame:
    """(part, phrase, a, l, r, score) of the phrases of two words or more that no longer one takes the place of.

    Products are decimals of 38 digits, exact for counts up to 10^16.
    """
    several = counts.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1).withColumnRenamed("f", "a")
    cuts = several.select("part", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("part", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest"))
    side = lambda name, f: counts.select(F.col("part"), F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(side("first", "l"), ["part", "first"]).join(side("rest", "r"), ["part", "rest"])
    wide = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"cast(cast({wide('a')} * {wide('a')} as decimal(31,0)) * 1000000bd as decimal(38,0)) div cast({wide('l')} * {wide('r')} as decimal(38,0))")
    best = both.groupBy("part", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("cut")).select("part", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")
    if most < 3:
        return best
    inner = lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.array_join(F.slice("words", i, n), " "))
    pieces = [F.when(F.size("words") > n, inner(n)).otherwise(F.array().cast("array<string>")) for n in range(2, most)]
    inside = several.where("size(words) > 2").select("part", F.col("a").alias("around"), F.explode(F.concat(*pieces)).alias("phrase")).groupBy("part", "phrase").agg(F.max("around").alias("around"))
    return best.join(inside, ["part", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around").cast("decimal(38,0)") < inside_percent * F.col("a").cast("decimal(38,0)"))).drop("around")


def collocations(docs: DataFrame, part: str = "lang", most: int = 3, least: int = 10, inside_percent: int = 50, top: int = 2000, shard_bytes: int = SHARD) -> DataFrame:
    """(part, rank, phrase, a, l, r, n, score): the best ``top`` phrases of two to ``most`` words of each part.

    Texts are taken with A-Z lower-cased, in pieces between ``.,;:!?`` and line ends; words are
    what spaces and tabs part.  a: how often the phrase is there, ``least`` or more; l, r: the
    same of what a cut of it gives; score: 1,000,000 a a / (l r), rounded down, of the cut where
    it is least, the first of such; n: all words of the part.  A phrase inside a longer one that is
    there in ``inside_percent`` or more of its cases is left out.  Ranks go by score, a, phrase.

    Null text is empty, a null part is ``und``.  Repeated rows count as often as they are there; ids
    and other columns don't matter.  A part without a phrase, and an empty table, give no row.
    """
    table = shards(docs, part, shard_bytes)
    sums = materialise(table.groupBy("part").agg(F.sum("words").alias("n")), "part-words")
    words = sums.agg(F.sum("n")).first()[0] or 0
    counts = phrase_counts(table, words, most, least)
    discard(table)
    place = Window.partitionBy("part").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(counts, most, inside_percent).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return ranked.join(sums, "part").select("part", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir)).withColumnRenamed("part", "lang")


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM t),
g AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM p
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p),
n AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, phrase, size, count(*) AS f FROM g GROUP BY lang, phrase, size HAVING count(*) >= 10),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
k AS (
  SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r,
         ((c.f::HUGEINT * c.f * 1000000) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c CROSS JOIN (VALUES (1), (2)) AS v(k)
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
  WHERE k < c.size),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, phrase, max(f) AS around
  FROM (SELECT lang, f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE size = 3) GROUP BY lang, phrase),
q AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN i ON b.lang = i.lang AND b.phrase = i.phrase
  WHERE around IS NULL OR 100 * around < 50 * a)
SELECT q.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score
FROM q JOIN n ON q.lang = n.lang WHERE rank <= 2000
"""
