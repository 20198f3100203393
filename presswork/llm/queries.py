"""The registered queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm import bpe, chat, exact_topk, licenses, mih, minhash, packing, pii, quality, warc
from presswork.llm.common import scratch_path, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mih.nearest(table(spark, sf_dir, "embeddings"), exact_topk.is_multiple(100), k=10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_topk.largest_products(table(spark, sf_dir, "embeddings"), exact_topk.is_multiple(20), k=20)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{chat.END}{chat.START}assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.chat_digests(chat.format_chats(turns.unionByName(extra)))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.archive_digests(warc.read_archives(spark, path))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mih, op2_pii, op3_exact_topk, op4_license, op5_bpe, op6_chat, op7_minhash, op8_warc, op9_packing, op10_quality)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_license": licenses.duckdb_sql()}
