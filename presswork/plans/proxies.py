"""The engine's relations as views over the supplied star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.sources.tables import parquet


def topic_facts(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_orderpriority").alias("topic_label"), F.col("o_orderdate").alias("crawl_date"))


def entity_links(spark: SparkSession, d: str) -> DataFrame:
    confidence = 1 - F.round(F.col("l_discount") * 100).cast("int") / F.lit(16.0)
    return parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("entity_id"), confidence.alias("confidence_score"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("normalized_name"))


def dated_articles(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth article has no date but a year and month; some of these are out of range."""
    orders = parquet(spark, d, "orders")
    bare = F.col("o_orderkey") % 5 == 0
    month = F.when(F.col("o_orderkey") % 50 == 0, 13).otherwise(F.month("o_orderdate"))
    return orders.select(F.col("o_orderkey").alias("id"), F.when(~bare, F.col("o_orderdate")).alias("crawl_date"), F.when(bare, F.year("o_orderdate")).alias("year"), F.when(bare, month).alias("month"))


def placed_articles(spark: SparkSession, d: str) -> DataFrame:
    listed = F.when(F.col("c_mktsegment") != "MACHINERY", F.concat_ws(",", F.col("c_nationkey").cast("string"), ((F.col("c_nationkey") + 7) % 25).cast("string")))
    customer = parquet(spark, d, "customer").select("c_custkey", listed.alias("id_countries"))
    return parquet(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), "id_countries")


def country(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label_en"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    line = parquet(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")
    return line.join(parquet(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))


def sentiment_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Languages are missing on every seventh line."""
    language = F.when(F.col("l_linenumber") != 7, F.col("l_returnflag"))
    return _pairs(spark, d).select(language.alias("language"), F.col("o_orderstatus").alias("a"), F.col("l_linestatus").alias("b"))


def topic_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The second rater takes every third line for medium, and skips every fifth."""
    second = F.when(F.col("l_linenumber") % 3 == 0, "3-MEDIUM").when(F.col("l_linenumber") % 5 == 0, "SKIPPED").otherwise(F.col("o_orderpriority"))
    return _pairs(spark, d).select(F.col("l_returnflag").alias("language"), F.col("o_orderpriority").alias("a"), second.alias("b"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "documents").select("doc_id", "text", "lang")
