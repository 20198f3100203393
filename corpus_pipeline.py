"""Corpus pipeline: documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm import minhash, packing, pii, quality
from presswork.llm.common import table, written
from presswork.llm.queries import VOCABULARY

#: Percent from which on the corpus takes documents for near copies; the query op7_minhash has its own, higher one.
SIMILAR = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from ``labels`` and these documents.

    Null texts are judged as empty ones; repeated rows are judged alike; without labels nothing is rejected; columns stay."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity ``SIMILAR`` or more.

    Rows are judged by their own texts, whatever ids they share; rows without words all stay; columns stay."""
    return minhash.keep_one(docs, percent=SIMILAR)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text, and stays null where it was.

    Null texts stay null; every row and every other column stays as it is."""
    return pii.redact(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long")))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens. A null text is the end id alone; repeated rows are packed each."""
    return packing.pack(docs, VOCABULARY)


STAGES = [("quality", good_quality), ("near_dedup", near_dedup), ("pii", redact_pii), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Token ids, learned scores and regular-expression spans are beyond SQL; tests hold brute force against the stages.
ORACLE_SQL: str | None = None
