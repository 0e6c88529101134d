"""BPE encoding and decoding of documents; see bpe.py for the method."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import codec
from .common import documents, ids_and_text, slices

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>): ids of each whole text; null and empty texts have none.

    Rows are independent: no shuffle, and repeated rows give repeated rows.
    """

    def run(batches):
        own = codec(path)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                ids = [np.frombuffer(own.encode(t or ""), own.dtype).astype(np.int32) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "ids"])

    return ids_and_text(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give the empty text."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.array(x or [], own.dtype).tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each text in one pass and return the digests of both."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                n, ids_sha, text_sha = [], [], []
                for text in part.column(1).to_pylist():
                    packed = own.encode(text or "")
                    ids = np.frombuffer(packed, own.dtype)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(own.decode(packed).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return ids_and_text(docs).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip_digests(documents(spark, sf_dir), vocabulary_path())
