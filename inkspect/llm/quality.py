"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (512 bytes each).  A passage is described by the
shares of its byte values and by how its words repeat, and encoded by one tanh
layer.  Gated attention, learned from document labels alone, weighs the passages;
the weighted sum is scored by a logistic layer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, ids_and_text, materialise, plain_text, slices, text_bytes
from .langid import crc_mod

PASSAGE = 512
FEATURES = 256 + 4
_MIX = np.random.default_rng(7).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | np.uint64(1)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, first passage of each document and the end): an empty text has one passage of zeros."""
    raw, offsets = text_bytes(column)
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    firsts = np.concatenate([[0], np.cumsum(counts)])
    n = int(firsts[-1])
    x = np.zeros((n, FEATURES), np.float32)
    if not len(raw):
        return x, firsts
    inside = np.arange(len(raw)) - np.repeat(offsets[:-1], sizes)
    of = np.repeat(firsts[:-1], sizes) + inside // PASSAGE
    counted = np.bincount(of * 256 + raw, minlength=n * 256).reshape(n, 256)
    x[:, :256] = np.sqrt(counted / np.maximum(1, counted.sum(1, keepdims=True)))

    blank = _BLANK[raw]
    begins = ~blank & (np.concatenate([[True], blank[:-1]]) | (inside == 0))
    starts = np.flatnonzero(begins)
    if len(starts):
        place = np.arange(len(raw)) - starts[np.maximum(0, np.cumsum(begins) - 1)]
        terms = _MIX[0][raw] * _MIX[1][place & 255]
        terms[blank] = 0
        words = np.add.reduceat(terms, starts)
        lengths = np.add.reduceat((~blank).astype(np.int64), starts)
        doc = np.searchsorted(offsets, starts, "right")
        passage = of[starts]
        each = np.maximum(1, np.bincount(passage, minlength=n))
        x[:, 256] = np.bincount(passage, lengths, minlength=n) / each / 10
        for k in (1, 2):
            same = np.zeros(len(words))
            same[k:] = (words[k:] == words[:-k]) & (doc[k:] == doc[:-k])
            x[:, 256 + k] = np.bincount(passage, same, minlength=n) / each
        x[:, 259] = np.log1p(np.bincount(passage, minlength=n)) / 5
    return x, firsts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, hidden: int = 24, attention: int = 16, seed: int = 1) -> Model:
        r = np.random.default_rng(seed)
        shape = {"E": (FEATURES, hidden), "V": (hidden, attention), "U": (hidden, attention), "a": (attention,), "c": (hidden,)}
        w = {k: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32) for k, s in shape.items()}
        return cls(w | {"e": np.zeros(hidden, np.float32), "b": np.zeros(1, np.float32), "mean": np.zeros(FEATURES, np.float32), "sd": np.ones(FEATURES, np.float32)})

    def forward(self, x: np.ndarray, firsts: np.ndarray):
        w, at, n = self.w, firsts[:-1], np.diff(firsts)
        x = (x - w["mean"]) / w["sd"]
        h = np.tanh(x @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (v * u) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), n))
        share = e / np.repeat(np.add.reduceat(e, at), n)
        z = np.add.reduceat(share[:, None] * h, at)
        return x, h, v, u, share, z, _sigmoid(z @ w["c"] + w["b"])

    def scores(self, x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        return self.forward(x, firsts)[-1] if len(firsts) > 1 else np.empty(0)

    def gradients(self, x, firsts, y) -> dict[str, np.ndarray]:
        w, n = self.w, np.diff(firsts)
        x, h, v, u, share, z, p = self.forward(x, firsts)
        ds = (p - y) / len(y)
        g = {"c": z.T @ ds, "b": np.array([ds.sum()])}
        dz = np.repeat(ds[:, None] * w["c"], n, axis=0)
        dshare = (dz * h).sum(1)
        de = share * (dshare - np.repeat(np.add.reduceat(share * dshare, firsts[:-1]), n))
        g["a"] = (v * u).T @ de
        dvu = de[:, None] * w["a"]
        dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
        g["V"], g["U"] = h.T @ dv, h.T @ du
        dh = (share[:, None] * dz + dv @ w["V"].T + du @ w["U"].T) * (1 - h * h)
        g["E"], g["e"] = x.T @ dh, dh.sum(0)
        return g


def train(x: np.ndarray, firsts: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.004, decay: float = 1e-4) -> Model:
    """Adam on the log loss; deterministic."""
    model, r = Model.fresh(), np.random.default_rng(3)
    if not len(y):
        return model
    model.w["mean"], model.w["sd"] = x.mean(0), x.std(0) + 0.02
    first, second, step = {}, {}, 0
    for _ in range(epochs):
        order = r.permutation(len(y))
        for i in range(0, len(y), batch):
            own = np.sort(order[i : i + batch])
            n = firsts[own + 1] - firsts[own]
            ends = np.concatenate([[0], np.cumsum(n)])
            rows = np.repeat(firsts[own] - ends[:-1], n) + np.arange(ends[-1])
            step += 1
            for k, g in model.gradients(x[rows], ends, y[own]).items():
                g = g + decay * model.w[k]
                first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                second[k] = 0.999 * second.get(k, 0) + 0.001 * g * g
                model.w[k] = (model.w[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, sample_docs: int = 2500, sample_passages: int = 40_000) -> Model:
    """Learn from about ``sample_docs`` labelled rows (by hash) that ``learn_from`` allows.

    A text gives a sixteenth of ``sample_passages`` at most, drawn from all of its
    passages.  Documents are taken in the order of a hash of their id until
    ``sample_passages`` are reached; only features of these passages reach the
    driver.  Both are bounds of the training sample alone.  Null and empty texts are
    one blank passage; rows that repeat an id each count.  Without labels the model
    is untrained and still scores every text.
    """
    known = labels.where(learn_from & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    there = known.count()
    if there > sample_docs:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(sample_docs / there * (1 << 30)))
    most = max(1, sample_passages // 16)
    order = F.xxhash64("doc_id", F.lit("order")).alias("order")
    labelled = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", order, "quality", plain_text().alias("text"))
    rows = materialise(labelled.withColumn("size", F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE)))), "quality-sample")
    before = F.sum("size").over(Window.orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))  # as many rows as sample_docs bounds
    ids = rows.select("doc_id", "order", "size", before.alias("taken")).where(F.col("taken") <= sample_passages).agg(F.max("order").alias("last")).first().last
    if ids is None:
        return Model.fresh()

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(2)):
                part = batch.slice(a, b - a)
                x, firsts = passages(part.column(2))
                packed = [x[drawn(i, j, most)].astype(np.float16).tobytes() for i, j in zip(firsts, firsts[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), pa.array(packed, pa.binary())], ["order", "quality", "x"])

    chosen = rows.where(F.col("order") <= ids).select("order", "quality", "text")
    bags, total = [], 0
    for r in sorted(chosen.mapInArrow(run, "order long, quality int, x binary").collect(), key=lambda r: (r.order, r.quality, r.x)):
        bag = np.frombuffer(r.x, np.float16).reshape(-1, FEATURES).astype(np.float32)
        total += len(bag)
        if total > sample_passages and bags:
            break
        bags.append((bag, r.quality))
    firsts = np.concatenate([[0], np.cumsum([len(b) for b, _ in bags])])
    return train(np.concatenate([b for b, _ in bags]), firsts, np.array([q for _, q in bags], np.float32))


def drawn(first: int, end: int, most: int) -> np.ndarray:
    """All of a text's passages, or ``most`` of them drawn without regard to their place."""
    n = int(end - first)
    return first + (np.arange(n) if n <= most else np.sort(np.random.default_rng(n).choice(n, most, replace=False)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each whole text; null is empty, and an empty text is a bag of one blank passage.

    Rows are independent: repeated rows give repeated rows, an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tens of kB, of fixed shape

    def run(batches):
        own = shared.value
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.scores(*passages(part.column(1))).astype(np.float64), pa.float64())], ["doc_id", "score"])

    return ids_and_text(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fit(docs, labels, crc_mod(4) != 2))
    return out.select("doc_id", (crc_mod(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
