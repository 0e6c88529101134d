"""Language ID: words first, then shorter and shorter character n-grams.

Each language has log frequencies of its words and of the character n-grams of
its words.  A text's words are looked up; a word that no language knows is scored
by its n-grams of the greatest length, each n-gram unseen at a length falling
back to those one shorter inside it, down to single characters.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, forget, ids_and_text, slices

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")  # letters, and numerals such as ½ that words() takes out
LONGEST = 4
UNIT = 1 << 32
MEMO_SCORES = 240_000  # of words or grams, by the number of languages
WORDS_AT_ONCE = 20_000  # whose n-grams are looked up together


def words(text: str) -> Counter:
    """The runs of letters (Unicode category L, as \\p{L}) of a text in lower case, and how often each occurs."""
    found = Counter(_WORD.findall(text.lower()))
    if not found or "".join(found).isalpha():
        return found
    for run in [x for x in found if not x.isalpha()]:
        n = found.pop(run)
        for word in "".join(c if c.isalpha() else " " for c in run).split():
            found[word] += n
    return found


class Table:
    """Log frequencies of strings in ten-thousandths: 64-bit hashes in order stand for the strings, with a row of each, a language a column."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.keys, self.logs = keys, logs

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, strings: list[str]) -> np.ndarray:
        """The row of each string, -1 where there is none."""
        wanted = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))
        if not len(self.keys):
            return np.full(len(strings), -1)
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, at, -1)

    def rows(self, at: np.ndarray) -> np.ndarray:
        return self.logs[at] / 1e4


class Memo:
    """Scores of strings met so far, a string a row; forgotten as a whole once there are too many."""

    def __init__(self, wide: int, most: int):
        self.place: dict[str, int] = {}
        self.scores, self.most = np.empty((0, wide)), most

    def start(self) -> None:
        if len(self.scores) > self.most:
            self.place, self.scores = {}, self.scores[:0]

    def missing(self, strings) -> list[str]:
        return list(set().union(*strings) - self.place.keys())

    def add(self, strings: list[str], scores: np.ndarray) -> None:
        self.place.update(zip(strings, range(len(self.scores), len(self.scores) + len(strings))))
        self.scores = np.concatenate([self.scores, scores])

    def forget(self, strings) -> None:
        for x in strings:
            del self.place[x]

    def find(self, strings, n: int) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, strings), np.int64, n)


class Model:
    """Languages, with one table of their words and one of the n-grams of all lengths."""

    def __init__(self, langs: list[str], words: Table, grams: Table):
        self.langs, self.words, self.grams = langs, words, grams
        most = MEMO_SCORES // max(4, len(langs))
        self.known, self.pieces = Memo(len(langs), most), Memo(len(langs), most)

    def for_a_task(self) -> Model:
        """The same tables with memos of their own, which go with the task."""
        return Model(self.langs, self.words, self.grams)

    def _learn_grams(self, grams) -> None:
        """Log probabilities of grams; of one unseen, the mean of those of its two parts one shorter."""
        new = self.pieces.missing([grams])
        if not new:
            return
        at = self.grams.find(new)
        scores = np.zeros((len(new), len(self.langs)))
        scores[at >= 0] = self.grams.rows(at[at >= 0])
        if lost := [i for i in np.flatnonzero(at < 0).tolist() if len(new[i]) > 1]:
            parts = [part for i in lost for part in (new[i][:-1], new[i][1:])]
            self._learn_grams(parts)
            scores[lost] = self.pieces.scores[self.pieces.find(parts, len(parts))].reshape(len(lost), 2, -1).mean(axis=1)
        self.pieces.add(new, scores)

    def _unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words by their longest n-grams, a row a word."""
        self.pieces.start()
        grams, sizes = [], []
        for word in words:
            marked = f"_{word}_"
            size = min(LONGEST, len(marked))
            grams += [marked[i : i + size] for i in range(len(marked) - size + 1)]
            sizes.append(len(marked) - size + 1)
        self._learn_grams(grams)
        found = self.pieces.scores[self.pieces.find(grams, len(grams))]
        return np.add.reduceat(found, np.cumsum([0, *sizes[:-1]])) / np.array(sizes)[:, None]

    def _learn_words(self, counts: list[Counter]) -> list[str]:
        """Scores of the words that are new, which it returns."""
        self.known.start()
        new = self.known.missing(counts)
        at = self.words.find(new)
        scores = np.empty((len(new), len(self.langs)))
        scores[at >= 0] = self.words.rows(at[at >= 0])
        lost = np.flatnonzero(at < 0).tolist()
        for i in range(0, len(lost), WORDS_AT_ONCE):
            own = lost[i : i + WORDS_AT_ONCE]
            scores[own] = self._unseen([new[k] for k in own])
        self.known.add(new, scores)
        return new

    def predict_all(self, texts: list[str]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its share of the likelihood, taken as if a text had at most 20 words.

        The words of all texts are looked up together, so these should be a slice.
        """
        counts, out = [words(text) for text in texts], []
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        new = self._learn_words(counts)
        for own in counts:
            if not own:
                out.append((UNKNOWN, 0.0))
                continue
            n = np.fromiter(own.values(), np.float64, len(own))
            x = n @ self.known.scores[self.known.find(own, len(own))] * min(1.0, 20 / n.sum())
            x = np.exp(x - x.max())
            best = int(x.argmax())
            out.append((self.langs[best], float(x[best] / x.sum())))
        self.known.forget(w for w in new if len(w) > 48)
        return out

    def predict(self, text: str) -> tuple[str, float]:
        return self.predict_all([text])[0]


def _pieces(counts) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language, size, key, weight) of words, at size 0, and of their n-grams, from (language, word, count); weights in units of 2^-32."""
    found: dict[str, tuple[defaultdict, defaultdict]] = {}
    for lang, word, n in counts:
        own, grams = found.setdefault(lang, (defaultdict(int), defaultdict(int)))
        own[word] += n * UNIT
        marked, weight = f"_{word}_", round(math.sqrt(n) * UNIT)
        for size in range(1, LONGEST + 1):
            for i in range(len(marked) - size + 1):
                grams[marked[i : i + size]] += weight
    rows = [(lang, 0 if whole else len(key), key, weight) for lang, both in found.items() for whole, own in zip((True, False), both) for key, weight in own.items()]
    keys = np.fromiter((xxhash.xxh64_intdigest(r[2]) for r in rows), np.uint64, len(rows))
    sizes, weights = np.fromiter((r[1] for r in rows), np.int32, len(rows)), np.fromiter((r[3] for r in rows), np.int64, len(rows))
    return [r[0] for r in rows], sizes, keys, weights


def _assemble(langs: list[str], sizes: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> Model:
    """A model from summed pieces."""
    names = sorted(set(langs))
    place = {lang: i for i, lang in enumerate(names)}
    at = np.fromiter((place[x] for x in langs), np.int64, len(langs))
    tables = []
    for size in range(LONGEST + 1):
        own = sizes == size
        uniq, row = np.unique(keys[own], return_inverse=True)
        sums = np.zeros((len(uniq), len(names)), np.int64)
        np.add.at(sums, (row, at[own]), weights[own])
        share = sums / UNIT
        totals = share.sum(axis=0) + 0.5 * len(uniq)
        tables.append((uniq, np.round(np.log((share + 0.5) / totals) * 1e4).astype(np.int32)))
    grams, logs = np.concatenate([t[0] for t in tables[1:]]), np.concatenate([t[1] for t in tables[1:]])
    order = np.argsort(grams)
    return Model(names, Table(*tables[0]), Table(grams[order], logs[order]))


def build(counts: list[tuple[str, str, int]]) -> Model:
    """A model from (language, word, count)."""
    return _assemble(*_pieces(counts))


def fit(docs: DataFrame, learn_from: Column, sample_docs: int = 20_000) -> Model:
    """Learn from about ``sample_docs`` rows (by hash) of those that ``learn_from`` allows and that have a language.

    Languages share that number evenly, and a language with fewer rows gives all of
    them.  Every word of these rows is in the model, and so is every n-gram of a word;
    executors count both, and hashes with their sums reach the driver.  The number of
    rows is the only bound.  Null texts teach nothing.  With no row to learn from, every
    text is ``und``.
    """
    rows = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    there = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not there:
        return build([])
    unit, each = 1 << 30, sample_docs / len(there)
    if large := [(lang, int(each / n * unit)) for lang, n in there.items() if n > each]:
        share = F.coalesce(F.create_map(*(F.lit(x) for pair in large for x in pair))[F.col("lang")], F.lit(unit))
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(unit)) < share)
    counts = rows.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))

    def run(batches):
        for batch in batches:
            langs, sizes, keys, weights = _pieces(zip(*(c.to_pylist() for c in batch.columns)))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sizes), pa.array(keys.view(np.int64)), pa.array(weights)], ["lang", "size", "key", "weight"])

    sums = counts.mapInArrow(run, "lang string, size int, key long, weight long").groupBy("lang", "size", "key").agg(F.sum("weight").alias("weight")).toArrow()
    return _assemble(sums["lang"].to_pylist(), sums["size"].to_numpy(), sums["key"].to_numpy().view(np.uint64), sums["weight"].to_numpy())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row; ``und`` and 0 where text is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size that fit() bounds

    def run(batches):
        forget()
        own = shared.value.for_a_task()
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                found = own.predict_all([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return ids_and_text(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, whose language is known with a score of ``least`` or more; null texts and those without a letter go.

    A model without languages knows nothing against a text that has a letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        forget()
        own = shared.value.for_a_task()
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                texts = part.column(at).to_pylist()
                if own.langs:
                    known = [lang != UNKNOWN and score >= least for lang, score in own.predict_all([t or "" for t in texts])]
                else:
                    known = [bool(words(t or "")) for t in texts]
                yield part.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def crc_mod(n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs, fit(docs, crc_mod(3) != 1))
    return out.select("doc_id", (crc_mod(3) == 1).alias("held_out"), "lang_pred", "score")
