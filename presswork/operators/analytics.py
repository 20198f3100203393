"""Monthly topic shares, peaks, entity rankings, rater agreement, votes, latency and the summary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions.scalars import country_ids, fixed, month_start, number_or_zero, ratio, stripped, year_month
from presswork.functions.vocabulary import SKIPPED, UNKNOWN


def _month_of(rows: DataFrame) -> Column:
    """The month of crawl_date; where the table has year and month, they stand in for a missing date."""
    y, m = (F.col(c) if c in rows.columns else None for c in ("year", "month"))
    return month_start(F.col("crawl_date"), y, m, dict(rows.dtypes)["crawl_date"])


def dated_topics(topics: DataFrame, articles: DataFrame) -> DataFrame:
    """Topic facts: (article_id, topic_label) rows with their article's date columns. Rows without an article go."""
    dates = [c for c in ("crawl_date", "year", "month") if c in articles.columns]
    return topics.select("article_id", "topic_label").join(articles.select(F.col("id").alias("article_id"), *dates), "article_id")


def topics_by_month(facts: DataFrame, exclude_skipped: bool = False) -> DataFrame:
    """Distinct articles per month and topic, and their share of the month's sum.

    facts: article_id, topic_label, crawl_date [, year, month]. Skipped articles count as a topic unless excluded."""
    rows = facts.where(F.col("topic_label").isNotNull()).withColumn("m", _month_of(facts)).where("m is not null")
    rows = rows.withColumn("topic_label", stripped(F.col("topic_label")))
    if exclude_skipped:
        rows = rows.where(F.col("topic_label") != SKIPPED)
    counts = rows.groupBy("m", "topic_label").agg(F.countDistinct("article_id").alias("articles_count"))
    total = F.sum("articles_count").over(Window.partitionBy("m"))
    return counts.select(year_month(F.col("m")).alias("year_month"), "topic_label", "articles_count", F.bround(ratio(F.col("articles_count"), total), 4).alias("topic_share"), total.alias("total_articles_in_month"))


def topics_in_order(by_month: DataFrame) -> DataFrame:
    """Months rising, largest topics first, then by name."""
    return by_month.orderBy("year_month", F.desc("articles_count"), "topic_label")


def dominant_topic(by_month: DataFrame) -> DataFrame:
    """The largest topic of each month, ties to the smaller name."""
    first = Window.partitionBy("year_month").orderBy(F.desc("articles_count"), "topic_label")
    best = by_month.withColumn("r", F.row_number().over(first)).where("r = 1")
    return best.select("year_month", F.col("topic_label").alias("dominant_topic"), F.col("articles_count").alias("dominant_articles_count"), F.col("topic_share").alias("dominant_topic_share"), "total_articles_in_month")


PEAK_INPUT = ("year_month", "topic_label", "articles_count", "total_articles_in_month", "topic_share")
PEAKS = "year_month string, topic_label string, articles_count long, total_articles_in_month long, topic_share double, roll_mean double, roll_std double, z_score double"


def densify(by_month: DataFrame) -> DataFrame:
    """Each topic in each month from the first to the last, missing counts 0. Topics and months are few:
    their product is the result itself. Counts that are no numbers are 0; rows without a month or topic go."""
    long = lambda c: number_or_zero(F.col(c), "long").alias(c)
    rows = by_month.select(F.to_date(F.try_to_timestamp("year_month", F.lit("yyyy-MM"))).alias("m"), stripped(F.col("topic_label")).alias("topic_label"), long("articles_count"), long("total_articles_in_month")).na.drop(subset=["m", "topic_label"])
    ends = rows.agg(F.min("m").alias("a"), F.max("m").alias("b")).where("a is not null")
    months = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    totals = rows.groupBy("m").agg(F.max("total_articles_in_month").alias("total_articles_in_month"))
    grid = rows.select("topic_label").distinct().crossJoin(months)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    full = grid.join(rows.select("topic_label", "m", "articles_count"), ["topic_label", "m"], "left").join(totals, "m", "left")
    return full.select("topic_label", "m", zero("articles_count"), zero("total_articles_in_month")).withColumn("topic_share", ratio(F.col("articles_count"), F.col("total_articles_in_month")))


def rolling(dense: DataFrame, window: int = 6, min_periods: int = 3, exclude_current: bool = False) -> DataFrame:
    """Rolling mean, sample deviation and z-score of the share, the current month in the frame."""
    w = Window.partitionBy("topic_label").orderBy("m").rowsBetween(-window if exclude_current else 1 - window, -1 if exclude_current else 0)
    seen = F.count("topic_share").over(w) >= min_periods
    out = dense.withColumn("roll_mean", F.when(seen, F.avg("topic_share").over(w))).withColumn("roll_std", F.when(seen, F.stddev_samp("topic_share").over(w)))
    ok = (F.col("roll_std") > 1e-12) & (F.col("total_articles_in_month") > 0)
    return out.withColumn("z_score", F.when(ok, (F.col("topic_share") - F.col("roll_mean")) / F.col("roll_std")).otherwise(0.0))


#: Digits of each figure in results.
PEAK_DIGITS = {"topic_share": 4, "roll_mean": 4, "roll_std": 6, "z_score": 3}


def rounded_peaks(rows: DataFrame) -> DataFrame:
    return rows.select(year_month(F.col("m")).alias("year_month"), "topic_label", "articles_count", "total_articles_in_month", *[F.bround(c, n).alias(c) for c, n in PEAK_DIGITS.items()])


def topic_peaks(by_month: DataFrame, window: int = 6, z_threshold: float = 2.5, min_periods: int = 3, min_articles: int = 5, exclude_current: bool = False) -> DataFrame:
    """Months in which a topic's share stands out. A frame that holds the current month bounds z by
    (window - 1) / sqrt(window): the defaults can't reach their threshold. A table that lacks a column has no peaks."""
    if set(PEAK_INPUT) - set(by_month.columns):
        return by_month.sparkSession.createDataFrame([], PEAKS)
    rows = rolling(densify(by_month), window, min_periods, exclude_current)
    return rounded_peaks(rows.where((F.col("total_articles_in_month") >= min_articles) & (F.col("z_score") >= z_threshold)))


def peaks_in_order(peaks: DataFrame) -> DataFrame:
    """Largest rounded z-scores first, then by month and topic."""
    return peaks.orderBy(F.desc("z_score"), "year_month", "topic_label")


def article_entities(links: DataFrame, entities: DataFrame) -> DataFrame:
    """(article_id, entity_type, normalized_name, n, c): mentions and best confidence of each name in each article.

    links: article_id, entity_id, confidence_score; entities: entity_id, entity_type, normalized_name. Links are dealt
    by article once; every later step by article keeps that dealing. Names that are null, blank, nan or none
    go, as do null and blank types."""
    dealt = links.select("article_id", "entity_id", "confidence_score").repartition("article_id")
    per_link = dealt.groupBy("article_id", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.max("confidence_score").alias("c"))
    names = entities.select("entity_id", F.upper(stripped(F.col("entity_type"))).alias("entity_type"), stripped(F.col("normalized_name")).alias("normalized_name"))
    names = names.where((F.col("entity_type") != "") & ~F.col("normalized_name").isin("", "nan", "none"))
    # several entities may share a name
    return per_link.join(names, "entity_id").groupBy("article_id", "entity_type", "normalized_name").agg(F.sum("n").alias("n"), F.max("c").alias("c"))


def _ranked(per: DataFrame, group: str, rank: str, top_k: int) -> DataFrame:
    """The first names of each group: by distinct articles, mentions, the mean over articles of the best
    confidence (rounded), name and type."""
    found = per.groupBy(group, "entity_type", "normalized_name").agg(F.count(F.lit(1)).alias("distinct_articles_count"), F.sum("n").alias("mentions_count"), F.bround(F.avg("c"), 4).alias("mean_confidence"))
    best = Window.partitionBy(group).orderBy(F.desc("distinct_articles_count"), F.desc("mentions_count"), F.desc_nulls_last("mean_confidence"), "normalized_name", "entity_type")
    return found.withColumn(rank, F.row_number().over(best)).where(F.col(rank) <= top_k)


_COUNTS = ("entity_type", "normalized_name", "distinct_articles_count", "mentions_count", "mean_confidence")


def entities_by_month(per_article: DataFrame, articles: DataFrame, top_k: int = 50) -> DataFrame:
    """per_article: of ``article_entities``; articles: id, crawl_date [, year, month]. Months join after names are
    counted; articles without a month go."""
    dated = articles.select(F.col("id").alias("article_id"), _month_of(articles).alias("m")).where("m is not null")
    out = _ranked(per_article.join(dated, "article_id"), "m", "rank_in_month", top_k)
    return out.select(year_month(F.col("m")).alias("year_month"), "rank_in_month", *_COUNTS)


def top_entities_by_country(per_article: DataFrame, articles: DataFrame, country: DataFrame, top_k: int = 50, default_country: int = 8) -> DataFrame:
    """articles: id, id_countries. Countries multiply rows last, right before the counts are combined."""
    placed = articles.select(F.col("id").alias("article_id"), country_ids(F.col("id_countries"), default_country).alias("ids"))
    rows = per_article.join(placed, "article_id").withColumn("country_id", F.explode("ids")).drop("ids")
    names = country.select(F.col("id").cast("int").alias("country_id"), "label_en")
    out = _ranked(rows, "country_id", "rank_in_country", top_k).join(names, "country_id", "left")
    return out.select("country_id", "label_en", "rank_in_country", *_COUNTS)


def paired(first: DataFrame, second: DataFrame, label: str) -> DataFrame:
    """(article_id, language, a, b): both raters' labels of the articles that both have; the first's language counts."""
    two = lambda t, x, lang: t.select("article_id", F.col(label).alias(x), F.col("language").alias(lang))
    return two(first, "a", "l").join(two(second, "b", "r"), "article_id").select("article_id", F.coalesce("l", "r").alias("language"), "a", "b")


def confusion(pairs: DataFrame, task: str, upper: bool) -> DataFrame:
    """(task, language, bert_label, qwen_label, count): counts per language and over all, without zeros.

    pairs: language, a, b. Null and skipped labels go; labels are stripped, and in upper case if asked for; null languages
    are unknown."""
    plain = lambda c: F.upper(stripped(F.col(c))) if upper else stripped(F.col(c))
    rows = pairs.where(f"a is not null and b is not null and a <> '{SKIPPED}' and b <> '{SKIPPED}'").select(F.lower(stripped(F.coalesce("language", F.lit("unknown")))).alias("language"), plain("a").alias("bert_label"), plain("b").alias("qwen_label"))
    sets = rows.groupingSets([["language", "bert_label", "qwen_label"], ["bert_label", "qwen_label"]], "language", "bert_label", "qwen_label")
    counted = sets.agg(F.count(F.lit(1)).alias("count"), F.grouping("language").alias("g"))
    named = F.when(F.col("g") == 1, "ALL").otherwise(F.col("language"))
    return counted.select(F.lit(task).alias("task"), named.alias("language"), "bert_label", "qwen_label", "count").where("language <> ''")


def agreement(counts: DataFrame) -> DataFrame:
    """(task, language, total_samples, agreement_count, accuracy, cohen_kappa), from ``confusion``. Raters that agree
    on one label throughout have a kappa of 1."""
    keys = ["task", "language"]
    same = F.when(F.col("bert_label") == F.col("qwen_label"), F.col("count")).otherwise(0)
    total = counts.groupBy(*keys).agg(F.sum("count").alias("total_samples"), F.sum(same).alias("agreement_count"))
    side = lambda c, to: counts.groupBy(*keys, F.col(c).alias("k")).agg(F.sum("count").alias(to))
    chance = side("bert_label", "na").join(side("qwen_label", "nb"), [*keys, "k"]).groupBy(*keys).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("x"))
    n = F.col("total_samples").cast("double")
    po, pe = F.col("agreement_count") / n, F.coalesce("x", F.lit(0.0)) / (n * n)
    kappa = F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe))
    return total.join(chance, keys, "left").select(*keys, "total_samples", "agreement_count", F.bround(po, 4).alias("accuracy"), F.bround(kappa, 4).alias("cohen_kappa"))


def model_comparison(sentiments: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics, confusion) of both tasks, from pairs of labels."""
    counts = confusion(sentiments, "sentiment", upper=True).unionByName(confusion(topics, "topic", upper=False))
    return agreement(counts), counts


def scopes_in_order(rows: DataFrame) -> DataFrame:
    """Sentiment before topic; all languages together first, then each by name, unknown ones last."""
    place = F.when(F.col("language") == "ALL", 0).when(F.col("language") == "unknown", 2).otherwise(1)
    return rows.orderBy("task", place, "language", *[c for c in ("qwen_label", "bert_label") if c in rows.columns])


def mean_latency(log: DataFrame, groups: Sequence[str], ms: str) -> DataFrame:
    """One row a group: mean milliseconds, seconds in all, documents."""
    return log.groupBy(*groups).agg(F.bround(F.avg(ms), 4).alias("avg_ms_per_doc"), F.bround(F.sum(ms) / 1000, 6).alias("total_inf_time_sec"), F.count(F.lit(1)).alias("docs"))


def with_mean_latency(log: DataFrame, groups: Sequence[str], ms: str) -> DataFrame:
    """Each row with its own seconds and its group's mean milliseconds. Means are counted before they join, so that a
    group of any size is dealt over all tasks."""
    means = log.groupBy(*groups).agg(F.bround(F.avg(ms), 4).alias("avg_ms_per_doc"))
    return log.join(means, list(groups), "left").withColumn("total_inf_time_sec", F.bround(F.col(ms) / 1000, 6))


def chunk_votes(votes: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """The label of each document: most chunks, then the highest sum of scores, then the first seen.

    votes: doc, chunk, label, score. vote_share is the winner's part of the chunks that count, mean_score its mean.
    With an ``order``, only its labels count and ties go to the earlier one; a document without any is UNK with 0."""
    valid = F.col("label").isin(list(order)) if order else F.col("label").isNotNull()
    place = F.array_position(F.array(*map(F.lit, order)), F.col("label")) if order else F.col("first")
    per = votes.groupBy("doc", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.min("chunk").alias("first"))
    best = F.max_by(F.struct("label", "n", "s"), F.when(valid, F.struct("n", "s", (-place).alias("f"))))
    won = per.groupBy("doc").agg(best.alias("b"), F.sum(F.when(valid, F.col("n"))).alias("chunks"))
    share = F.coalesce(F.col("b.n") / F.col("chunks"), F.lit(0.0))
    return won.select("doc", F.coalesce("b.label", F.lit(UNKNOWN)).alias("label"), F.coalesce("b.n", F.lit(0).cast("long")).alias("votes"), share.alias("vote_share"), F.coalesce(F.col("b.s") / F.col("b.n"), F.lit(0.0)).alias("mean_score"))


SUMMARY = ("section", "period_or_scope", "category", "item_name", "metric_count", "metric_share_or_score", "details")
#: The sections in order.
SECTIONS = ("OVERVIEW_METRICS", "DOMINANT_TOPICS_BY_MONTH", "TOPIC_SURGES_PEAKS", "TOP_ENTITIES_BY_MONTH", "TOP_ENTITIES_BY_COUNTRY", "MODEL_COMPARISON")


def _lines(rows: DataFrame, section: int, values: Sequence[Column]) -> DataFrame:
    period, category, item, count, score, details = values
    typed = (F.lit(SECTIONS[section]), period.cast("string"), category.cast("string"), item.cast("string"), count.cast("long"), score.cast("double"), details)
    return rows.select(*[c.alias(name) for c, name in zip(typed, SUMMARY, strict=True)])


def _said(*parts: Column | str) -> Column:
    """Text and figures in a row; a missing figure reads as 0."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("0")) for p in parts])


def _percent(x: Column) -> Column:
    return F.concat(fixed(100 * F.coalesce(x, F.lit(0.0)), 1), F.lit("%"))


def _kpis(by_month: DataFrame, peaks: DataFrame, by_entity: DataFrame) -> DataFrame:
    """The five lines of the overview, from one row of totals."""
    months = by_month.groupBy("year_month").agg(F.max("total_articles_in_month").alias("n"))
    spans = months.agg(F.count("year_month").alias("months"), F.min("year_month").alias("a"), F.max("year_month").alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("articles"))
    spans = spans.crossJoin(by_month.agg(F.countDistinct("topic_label").alias("topics"))).crossJoin(peaks.agg(F.count(F.lit(1)).alias("peaks"))).crossJoin(by_entity.agg(F.countDistinct("normalized_name").alias("names")))  # one row each
    whole = F.coalesce(F.concat("a", F.lit(" -> "), "b"), F.lit("N/A"))
    all_of = F.lit("All Available")
    lines = [
        (whole, "Active Date Range (Months)", F.col("months"), _said("Covered time span: ", whole, " (", F.col("months"), " monthly intervals)")),
        (all_of, "Total Processed Articles in Analytics", F.col("articles"), _said("Cumulative volume across analyzed monthly buckets: ", F.format_number("articles", 0), " articles")),
        (all_of, "Distinct Topic Categories", F.col("topics"), _said("Total distinct topic labels classified: ", F.col("topics"))),
        (all_of, "Topic Surges Detected (Z >= 2.5)", F.col("peaks"), _said("Detected anomaly spikes in topic share: ", F.col("peaks"), " occurrences")),
        (all_of, "Top Unique Named Entities", F.col("names"), _said("Total distinct top entity entries tracked across months: ", F.col("names"))),
    ]
    entry = lambda i, line: F.struct(F.lit(i).alias("i"), line[0].alias("period"), F.lit(line[1]).alias("item"), line[2].cast("long").alias("n"), line[3].alias("details"))
    rows = spans.select(F.explode(F.array(*[entry(i, x) for i, x in enumerate(lines)])).alias("l")).select("l.*")
    return _lines(rows, 0, (F.col("period"), F.lit("KPI"), F.col("item"), F.col("n"), F.lit(None), F.col("details")))


def summary(by_month: DataFrame, peaks: DataFrame, by_entity: DataFrame, by_country: DataFrame, metrics: DataFrame, top_n: int = 5) -> DataFrame:
    """Six sections in one layout of seven columns. An empty input leaves its section out, but for the overview."""
    col, zero = F.col, lambda c: F.coalesce(F.col(c), F.lit(0.0))
    counted = lambda where: _said("Rank #", col("rank"), " in ", where, " (", col("distinct_articles_count"), " articles, ", col("mentions_count"), " mentions, conf: ", fixed(zero("mean_confidence"), 3), ")")
    top = lambda rows, rank: rows.withColumnRenamed(rank, "rank").where(col("rank") <= top_n)
    entity = (F.concat(F.lit("ENTITY_"), "entity_type"), col("normalized_name"), col("distinct_articles_count"), F.bround(zero("mean_confidence"), 4))
    label = stripped(col("label_en"))
    place = F.when(~F.lower(label).isin("nan", "none", ""), label).otherwise(_said("Country ID ", col("country_id")))
    task, scope = F.upper("task"), F.upper("language")
    parts = [
        _kpis(by_month, peaks, by_entity),
        _lines(dominant_topic(by_month), 1, (col("year_month"), F.lit("TOPIC"), col("dominant_topic"), col("dominant_articles_count"), F.bround("dominant_topic_share", 4), _said("Dominant topic in ", col("year_month"), " (", col("dominant_articles_count"), "/", col("total_articles_in_month"), " articles, ", _percent(col("dominant_topic_share")), " share)"))),
        _lines(peaks, 2, (col("year_month"), F.lit("TOPIC_PEAK"), col("topic_label"), col("articles_count"), F.bround("z_score", 3), _said("Spike Z=", fixed(zero("z_score"), 2), " (Share: ", _percent(col("topic_share")), " vs rolling avg: ", _percent(col("roll_mean")), ", Count: ", col("articles_count"), ")"))),
        _lines(top(by_entity, "rank_in_month"), 3, (col("year_month"), *entity, counted(col("year_month")))),
        _lines(top(by_country, "rank_in_country").withColumn("place", place), 4, (col("place"), *entity, counted(col("place")))),
        _lines(metrics, 5, (scope, F.concat(F.lit("AGREEMENT_"), task), F.concat(F.initcap(F.lower(task)), F.lit(" Agreement (BERT vs Qwen)")), col("total_samples"), F.bround("cohen_kappa", 4), _said("Scope: ", scope, " | Accuracy: ", _percent(col("accuracy")), " (", col("agreement_count"), "/", col("total_samples"), ") | Cohen's Kappa: ", fixed(zero("cohen_kappa"), 3)))),
    ]
    return reduce(DataFrame.unionByName, parts)
