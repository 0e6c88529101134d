"""A training-data pipeline over ``documents``: five stages, each one operator.

Every stage takes the table that the one before has left and, but for the last,
returns rows in its columns, whatever other columns there are.  Null text counts as
empty.  Null ids are documents like others.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspect.llm import langid, line_dedup, packing, substring_dedup, tokenise
from inkspect.llm import near_copies as near
from inkspect.llm.common import documents, materialise, with_text


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too) or with an uncertain language go; languages are learned from labelled rows.

    Repeated rows are judged alike.  Where no row has a language, all with a letter stay.
    """
    return langid.keep_known(docs, langid.fit(docs, F.lit(True)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the last of them alone; rows that repeat an id are one document, and all rows stay."""
    return with_text(docs, line_dedup.dedup_lines(docs), "kept_text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 or more of shared five-word shingles stays, the one with the smallest id, in one row.

    SimHash links those within three bits, confirmed exactly; segments of shingle sets find
    the rest, which it can't reach (README).  Texts without words are one group.
    """
    return near.keep_one(docs, size=5)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id holds go; all rows stay, and a null id comes after all others."""
    return with_text(docs, substring_dedup.dedup_substrings(docs, carry=True), "kept_text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, a row per piece; an empty text is its end token alone, and repeated rows are packed once each."""
    return packing.pack(docs, tokenise.vocabulary_path())


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("substring_dedup", substrings), ("packing", pack)]

#: Fingerprints, chunks and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
