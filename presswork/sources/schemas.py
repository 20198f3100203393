"""The engine's relations: columns, keys, and the statements that make them tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Relation:
    """Columns as DDL, the key, and columns of earlier versions: names that are dropped when a table is brought up to date."""

    columns: str
    key: tuple[str, ...]
    dropped: tuple[str, ...] = ()

    def schema(self) -> StructType:
        return StructType.fromDDL(self.columns)


_TIMES = ("gpu_time_ner", "gpu_time_sentiment", "gpu_time_topic")
_BENCHMARK = "article_id bigint, task string, model_id tinyint, language string, device string, total_inf_time_sec double, avg_ms_per_doc double, peak_gpu_mb double, created_at timestamp"
_BENCHMARK_KEY = ("article_id", "task", "model_id", "language", "device")
_COUNTS = "entity_type string, normalized_name string, distinct_articles_count int, mentions_count int, mean_confidence double, created_at timestamp"

#: Inputs and results by name.
RELATIONS = {
    "article": Relation("id bigint, body string, id_language int, id_categories int, crawl_date timestamp, year int, month int, id_countries string", ("id",)),
    "country": Relation("id int, label_en string, label_fr string, label_ar string", ("id",)),
    "article_sentiments": Relation("article_id bigint, language string, sentiment_label string, sentiment_score double", ("article_id",), _TIMES),
    "entities": Relation("entity_id bigint, entity_name string, entity_type string, normalized_name string, frequency int", ("entity_id",)),
    "article_entities": Relation("article_id bigint, entity_id bigint, model_version tinyint, confidence_score double", ("article_id", "entity_id", "model_version")),
    "article_topics": Relation("article_id bigint, language string, topic_label string, topic_score double", ("article_id",)),
    "qwen_article_topics": Relation("article_id bigint, language string, topic_label string", ("article_id",), ("topic_score",)),
    "qwen_article_sentiments": Relation("article_id bigint, language string, sentiment_label string", ("article_id",), ("sentiment_score", *_TIMES[1:])),
    "benchmark_results": Relation(_BENCHMARK, _BENCHMARK_KEY, ("load_time_sec",)),
    "qwen_benchmark_results": Relation(_BENCHMARK, _BENCHMARK_KEY, ("load_time_sec",)),
    "analytics_topics_by_month": Relation("id bigint, year_month string, topic_label string, articles_count int, topic_share double, total_articles_in_month int, created_at timestamp", ("id",)),
    "analytics_topic_peaks": Relation("id bigint, year_month string, topic_label string, articles_count int, total_articles_in_month int, topic_share double, roll_mean double, roll_std double, z_score double, created_at timestamp", ("id",)),
    "analytics_entities_by_month": Relation(f"id bigint, year_month string, rank_in_month int, {_COUNTS}", ("id",)),
    "analytics_top_entities_by_country": Relation(f"id bigint, country_id int, label_en string, rank_in_country int, {_COUNTS}", ("id",)),
}
INPUTS = ("article", "country")
#: Earlier names of tables, and tables that are no longer kept.
RENAMED = {"articles_enriched": "article_sentiments", "qwen_articles_enriched": "qwen_article_sentiments"}
RETIRED = ("analytics_dominant_topics",)


def create_statement(name: str, database: str | None = None) -> str:
    """A Parquet table for a relation, made only if it isn't there."""
    return f"CREATE TABLE IF NOT EXISTS {_named(name, database)} ({RELATIONS[name].columns}) USING parquet"


def _named(name: str, database: str | None) -> str:
    return f"`{database}`.`{name}`" if database else f"`{name}`"


def conformed(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the columns of a relation: missing ones null, types cast (what can't be cast is null), others left out."""
    fields = RELATIONS[name].schema().fields
    return df.select(*[(F.col(f.name).cast("string").try_cast(f.dataType) if f.name in df.columns and dict(df.dtypes)[f.name] == "string" else F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def upgrade(spark: SparkSession, database: str | None = None) -> list[str]:
    """Makes all result tables, and brings those of earlier versions up to date; returns what was done.

    Old names go over to new ones where the new one isn't there yet, retired tables go, analytics tables of a
    layout without ``id`` are made anew (they are computed again with each report), missing columns come as nulls, and
    dropped ones go. Parquet tables can't lose columns in place: such a table is written beside and renamed."""
    has = lambda name: spark.catalog.tableExists(f"{database}.{name}" if database else name)
    done: list[str] = []

    def run(sql: str) -> None:
        spark.sql(sql)
        done.append(sql)

    for old, new in RENAMED.items():
        if has(old) and not has(new):
            run(f"ALTER TABLE {_named(old, database)} RENAME TO {_named(new, database)}")
    for name in RETIRED:
        if has(name):
            run(f"DROP TABLE {_named(name, database)}")
    for name, relation in RELATIONS.items():
        if name in INPUTS:
            continue
        here = _named(name, database)
        if has(name):
            columns = spark.table(here).columns
            if name.startswith("analytics_") and "id" not in columns:
                run(f"DROP TABLE {here}")
            elif missing := [f for f in relation.columns.split(", ") if f.split(" ")[0] not in columns]:
                run(f"ALTER TABLE {here} ADD COLUMNS ({', '.join(missing)})")
            if has(name) and set(columns) & set(relation.dropped):
                beside = _named(f"{name}_upgraded", database)
                kept = ", ".join(f"`{c}`" for c in spark.table(here).columns if c not in relation.dropped)
                run(f"CREATE TABLE {beside} USING parquet AS SELECT {kept} FROM {here}")
                run(f"DROP TABLE {here}")
                run(f"ALTER TABLE {beside} RENAME TO {here}")
        if not has(name):
            run(create_statement(name, database))
    return done


def drop_results(spark: SparkSession, database: str | None = None) -> None:
    for name in RELATIONS:
        if name not in INPUTS:
            spark.sql(f"DROP TABLE IF EXISTS {_named(name, database)}")
