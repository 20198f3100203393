"""All analytics tables and reports from the result tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswork.operators import analytics as A
from presswork.sources.schemas import RELATIONS, conformed
from presswork.sources.tables import relation, replace_table, report_csv


def _save(df: DataFrame, order: list, folder: str, name: str) -> int:
    """A result table in its declared layout, numbered in report order. Its rows are few (months times topics, or the
    first names of each group), so one task numbers them."""
    numbered = df.withColumn("id", F.row_number().over(Window.orderBy(*order))).withColumn("created_at", F.current_timestamp())
    return replace_table(conformed(numbered, name), f"{folder}/{name}.parquet")


def analytics_reports(
    spark: SparkSession,
    source: str,
    target: str,
    run_dir: str | None = None,
    top_entities_k: int = 50,
    top_entities_by_month_k: int = 50,
    peaks_window: int = 6,
    peaks_z_threshold: float = 2.5,
    default_country_id: int = 8,
) -> dict[str, int]:
    """Writes the four analytics tables below ``target``, and with a ``run_dir`` the CSV reports; rows of each.

    ``source`` holds the input and result tables; one that is missing counts as empty. Every table is written
    once and read again where a later step needs it. Empty results empty their table; empty comparisons make no file."""
    t = {name: relation(spark, source, name) for name in RELATIONS}
    back = lambda name: relation(spark, target, name)
    rows: dict[str, int] = {}

    topics = A.topics_by_month(A.dated_topics(t["article_topics"], t["article"]))
    rows["analytics_topics_by_month"] = _save(topics, ["year_month", F.desc("articles_count"), "topic_label"], target, "analytics_topics_by_month")
    by_month = back("analytics_topics_by_month")
    peaks = A.topic_peaks(by_month, peaks_window, peaks_z_threshold)
    rows["analytics_topic_peaks"] = _save(peaks, [F.desc("z_score"), "year_month", "topic_label"], target, "analytics_topic_peaks")

    per = A.article_entities(t["article_entities"], t["entities"])
    months = A.entities_by_month(per, t["article"], top_entities_by_month_k)
    rows["analytics_entities_by_month"] = _save(months, ["year_month", "rank_in_month"], target, "analytics_entities_by_month")
    countries = A.top_entities_by_country(per, t["article"], t["country"], top_entities_k, default_country_id)
    rows["analytics_top_entities_by_country"] = _save(countries, ["country_id", "rank_in_country"], target, "analytics_top_entities_by_country")

    metrics, counts = A.model_comparison(
        A.paired(t["article_sentiments"], t["qwen_article_sentiments"], "sentiment_label"),
        A.paired(t["article_topics"], t["qwen_article_topics"], "topic_label"),
    )
    if run_dir is not None:
        rows["model_comparison_metrics"] = report_csv(A.scopes_in_order(metrics), f"{run_dir}/model_comparison_metrics.csv", if_rows=True)
        rows["model_comparison_confusion"] = report_csv(A.scopes_in_order(counts), f"{run_dir}/model_comparison_confusion.csv", if_rows=True)
        whole = A.summary(by_month, back("analytics_topic_peaks"), back("analytics_entities_by_month"), back("analytics_top_entities_by_country"), metrics)
        rows["analytics_summary"] = report_csv(whole, f"{run_dir}/analytics_summary.csv", if_rows=True)
    return rows
