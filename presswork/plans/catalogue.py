"""The registered queries of the news engine and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions import cleaning as C
from presswork.functions import language as L
from presswork.functions import rules as R
from presswork.functions import scalars as S
from presswork.functions import spans as SP
from presswork.functions import vocabulary as V
from presswork.operators import analytics as A
from presswork.operators import enrichment as E
from presswork.operators import merging as M
from presswork.operators import scoring as G
from presswork.plans import proxies as P
from presswork.sources.tables import parquet

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


_COUNTS = "SELECT date_trunc('month', o_orderdate)::DATE AS m, o_orderpriority AS topic_label, count(DISTINCT o_orderkey) AS articles_count FROM orders GROUP BY 1, 2"
_MONTHLY = f"SELECT strftime(m, '%Y-%m') AS year_month, m, topic_label, articles_count, sum(articles_count) OVER (PARTITION BY m)::BIGINT AS total_articles_in_month FROM ({_COUNTS})"
_TOPICS = f"SELECT year_month, topic_label, articles_count, round_even(articles_count / total_articles_in_month, 4) AS topic_share, total_articles_in_month FROM ({_MONTHLY})"


def _topics(spark: SparkSession, d: str) -> DataFrame:
    return A.topics_by_month(P.topic_facts(spark, d))


@_register(_TOPICS)
def topics_by_month(spark: SparkSession, d: str) -> DataFrame:
    return _topics(spark, d)


_DOMINANT = f"SELECT year_month, topic_label AS dominant_topic, articles_count AS dominant_articles_count, topic_share AS dominant_topic_share, total_articles_in_month FROM ({_TOPICS}) QUALIFY row_number() OVER (PARTITION BY year_month ORDER BY articles_count DESC, topic_label) = 1"


@_register(_DOMINANT)
def dominant_topic(spark: SparkSession, d: str) -> DataFrame:
    return A.dominant_topic(_topics(spark, d))


_GRID = f"""
WITH t AS ({_MONTHLY}),
e AS (SELECT min(m) AS a, max(m) AS b FROM t),
c AS (SELECT unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM e),
k AS (SELECT DISTINCT topic_label FROM t),
n AS (SELECT m, max(total_articles_in_month) AS n FROM t GROUP BY 1),
g AS (SELECT k.topic_label, c.m, coalesce(t.articles_count, 0) AS articles_count, coalesce(n.n, 0) AS total_articles_in_month
      FROM k CROSS JOIN c LEFT JOIN t ON t.topic_label = k.topic_label AND t.m = c.m LEFT JOIN n ON n.m = c.m),
s AS (SELECT *, CASE WHEN total_articles_in_month > 0 THEN articles_count / total_articles_in_month ELSE 0 END AS topic_share FROM g)
"""


@_register(_GRID + "SELECT topic_label, strftime(m, '%Y-%m') AS year_month, articles_count, total_articles_in_month, round_even(topic_share, 4) AS topic_share FROM s")
def calendar_densify(spark: SparkSession, d: str) -> DataFrame:
    return A.densify(_topics(spark, d)).select("topic_label", S.year_month(F.col("m")).alias("year_month"), "articles_count", "total_articles_in_month", F.bround("topic_share", 4).alias("topic_share"))


def _rolling_sql(window: int) -> str:
    w = f"(PARTITION BY topic_label ORDER BY m ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    return _GRID + f""",
r AS (SELECT *, CASE WHEN count(*) OVER {w} >= 3 THEN avg(topic_share) OVER {w} END AS roll_mean, CASE WHEN count(*) OVER {w} >= 3 THEN stddev_samp(topic_share) OVER {w} END AS roll_std FROM s),
z AS (SELECT *, CASE WHEN roll_std > 1e-12 AND total_articles_in_month > 0 THEN (topic_share - roll_mean) / roll_std ELSE 0 END AS z_score FROM r)
"""


_FIVE = "strftime(m, '%Y-%m') AS year_month, topic_label, articles_count, total_articles_in_month, round_even(topic_share, 4) AS topic_share, round_even(roll_mean, 4) AS roll_mean, round_even(roll_std, 6) AS roll_std, round_even(z_score, 3) AS z_score"


@_register(_rolling_sql(6) + f"SELECT {_FIVE} FROM z")
def rolling_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.rounded_peaks(A.rolling(A.densify(_topics(spark, d))))


def _peaks_sql(window: int, z: float) -> str:
    return _rolling_sql(window) + f"SELECT {_FIVE} FROM z WHERE total_articles_in_month >= 5 AND z_score >= {z}"


@_register(_peaks_sql(6, 2.5))
def topic_peaks_default(spark: SparkSession, d: str) -> DataFrame:
    return A.topic_peaks(_topics(spark, d))


@_register(_peaks_sql(6, 1.5))
def topic_peaks_w6_z15(spark: SparkSession, d: str) -> DataFrame:
    return A.topic_peaks(_topics(spark, d), 6, 1.5)


@_register(_peaks_sql(12, 2.0))
def topic_peaks_w12_z20(spark: SparkSession, d: str) -> DataFrame:
    return A.topic_peaks(_topics(spark, d), 12, 2.0)


_MENTIONS = "SELECT l_orderkey AS article_id, upper(trim(p_type)) AS entity_type, trim(p_name) AS normalized_name, 1 - CAST(round(l_discount * 100) AS INT) / CAST(16 AS DOUBLE) AS c, o_orderdate, o_custkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey"


def _entity_sql(rows: str, group: str, rank: str) -> str:
    return f"""
WITH r AS ({rows}),
p AS (SELECT {group}, entity_type, normalized_name, article_id, count(*) AS n, max(c) AS c FROM r WHERE normalized_name NOT IN ('', 'nan', 'none') AND entity_type <> '' GROUP BY ALL),
f AS (SELECT {group}, entity_type, normalized_name, count(*) AS distinct_articles_count, sum(n)::BIGINT AS mentions_count, round_even(avg(c), 4) AS mean_confidence FROM p GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY distinct_articles_count DESC, mentions_count DESC, mean_confidence DESC NULLS LAST, normalized_name, entity_type) AS {rank} FROM f)
"""


def _per_article(spark: SparkSession, d: str) -> DataFrame:
    return A.article_entities(P.entity_links(spark, d), P.entities(spark, d))


# every fifth article is dated by year and month only, every fiftieth by a month that is none
_BY_MONTH = _entity_sql(f"SELECT *, strftime(o_orderdate, '%Y-%m') AS year_month FROM ({_MENTIONS}) WHERE article_id % 50 <> 0", "year_month", "rank_in_month") + "SELECT * FROM k WHERE rank_in_month <= 50"


@_register(_BY_MONTH)
def entities_by_month(spark: SparkSession, d: str) -> DataFrame:
    return A.entities_by_month(_per_article(spark, d), P.dated_articles(spark, d))


_COUNTRIES = f"SELECT m.*, unnest(CASE WHEN c_mktsegment = 'MACHINERY' THEN [8] ELSE [c_nationkey, (c_nationkey + 7) % 25] END) AS country_id FROM ({_MENTIONS}) m JOIN customer ON o_custkey = c_custkey"
_BY_COUNTRY = _entity_sql(_COUNTRIES, "country_id", "rank_in_country") + "SELECT k.*, n_name AS label_en FROM k LEFT JOIN nation ON country_id = n_nationkey WHERE rank_in_country <= 50"


@_register(_BY_COUNTRY)
def top_entities_by_country(spark: SparkSession, d: str) -> DataFrame:
    return A.top_entities_by_country(_per_article(spark, d), P.placed_articles(spark, d), P.country(spark, d))


@_register("SELECT p_partkey AS entity_id, p_name AS normalized_name, coalesce(n, 0) AS frequency FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def entity_frequency(spark: SparkSession, d: str) -> DataFrame:
    entities = parquet(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("normalized_name"), F.lit(0).cast("long").alias("frequency"))
    return M.refresh_frequency(entities, parquet(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id")))


_SENTIMENT_PAIRS = "SELECT 'sentiment' AS task, lower(coalesce(CASE WHEN l_linenumber <> 7 THEN l_returnflag END, 'unknown')) AS language, upper(trim(o_orderstatus)) AS a, upper(trim(l_linestatus)) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_TOPIC_PAIRS = """
SELECT 'topic' AS task, lower(l_returnflag) AS language, trim(o_orderpriority) AS a, CASE WHEN l_linenumber % 3 = 0 THEN '3-MEDIUM' ELSE trim(o_orderpriority) END AS b
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber % 3 = 0 OR l_linenumber % 5 <> 0
"""


def _confusion_sql(pairs: str) -> str:
    return f"SELECT task, CASE WHEN grouping(language) = 1 THEN 'ALL' ELSE language END AS language, a AS bert_label, b AS qwen_label, count(*) AS count FROM ({pairs}) GROUP BY GROUPING SETS ((task, language, a, b), (task, a, b))"


def _agreement_sql(counts: str) -> str:
    return f"""
WITH c AS ({counts}),
t AS (SELECT task, language, sum(count)::BIGINT AS n, sum(CASE WHEN bert_label = qwen_label THEN count ELSE 0 END)::BIGINT AS agreement_count FROM c GROUP BY 1, 2),
l AS (SELECT task, language, bert_label AS k, sum(count) AS n FROM c GROUP BY 1, 2, 3), r AS (SELECT task, language, qwen_label AS k, sum(count) AS n FROM c GROUP BY 1, 2, 3),
x AS (SELECT l.task, l.language, sum(l.n::DOUBLE * r.n) AS x FROM l JOIN r ON l.task = r.task AND l.language = r.language AND l.k = r.k GROUP BY 1, 2),
p AS (SELECT t.*, agreement_count / n::DOUBLE AS po, coalesce(x, 0) / (n::DOUBLE * n) AS pe FROM t LEFT JOIN x USING (task, language))
SELECT task, language, n AS total_samples, agreement_count, round_even(po, 4) AS accuracy, round_even(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 4) AS cohen_kappa FROM p
"""


@_register(_confusion_sql(_SENTIMENT_PAIRS))
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return A.confusion(P.sentiment_pairs(spark, d), "sentiment", upper=True)


@_register(_agreement_sql(_confusion_sql(_SENTIMENT_PAIRS)))
def agreement_metrics(spark: SparkSession, d: str) -> DataFrame:
    return A.agreement(A.confusion(P.sentiment_pairs(spark, d), "sentiment", upper=True))


@_register(f"SELECT language, cohen_kappa FROM ({_agreement_sql(_confusion_sql(_TOPIC_PAIRS))})")
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return A.agreement(A.confusion(P.topic_pairs(spark, d), "topic", upper=False)).select("language", "cohen_kappa")


_BOTH = f"{_confusion_sql(_SENTIMENT_PAIRS)} UNION ALL {_confusion_sql(_TOPIC_PAIRS)}"
_METRICS = _agreement_sql(_BOTH)


@_register(_METRICS)
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    return A.model_comparison(P.sentiment_pairs(spark, d), P.topic_pairs(spark, d))[0]


@_register(_BOTH)
def model_comparison_confusion(spark: SparkSession, d: str) -> DataFrame:
    return A.model_comparison(P.sentiment_pairs(spark, d), P.topic_pairs(spark, d))[1]


@_register("SELECT doc_id AS id FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic <> 1 AND quality IS NOT NULL)")
def unprocessed_articles(spark: SparkSession, d: str) -> DataFrame:
    done = parquet(spark, d, "labels").select(F.col("doc_id").alias("article_id"), F.when(F.col("toxic") != 1, F.col("quality")).alias("label"))
    return M.unprocessed(parquet(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")), done, "label").select("id")


@_register("""
SELECT doc_id AS article_id, lang AS language, CASE WHEN l.toxic = 0 THEN l.quality WHEN doc_id % 3 = 0 THEN 7 END AS label, n_chars FROM documents LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT -1 - event_id, 'xx', 1, NULL FROM events WHERE event_id < 20
""")
def upsert_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Labels merged into rows with a language, some with an old label: nulls don't replace it. New keys come, too;
    a column that the batch lacks stays."""
    docs = parquet(spark, d, "documents")
    old = docs.select(F.col("doc_id").alias("article_id"), F.col("lang").alias("language"), F.when(F.col("doc_id") % 3 == 0, 7).alias("label"), "n_chars")
    known = parquet(spark, d, "labels").select(F.col("doc_id").alias("article_id"), F.lit(None).cast("string").alias("language"), F.when(F.col("toxic") == 0, F.col("quality")).alias("label"), F.lit(1).alias("seq"))
    fresh = parquet(spark, d, "events").where("event_id < 20").select((-1 - F.col("event_id")).alias("article_id"), F.lit("xx").alias("language"), F.lit(1).alias("label"), F.lit(2).alias("seq"))
    later = fresh.select("article_id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("int").alias("label"), F.lit(3).alias("seq"))
    return M.merge_coalesce(old, known.unionByName(fresh).unionByName(later), ["article_id"], ["language", "label"], "seq")


@_register("""
WITH l AS (SELECT l_orderkey AS article_id, l_partkey AS entity_id, l_linenumber AS model_version, 1 - l_discount AS c FROM lineitem),
o AS (SELECT article_id, entity_id, model_version, CASE WHEN article_id % 11 <> 0 THEN max(c) END AS o FROM l WHERE c < 0.95 GROUP BY article_id, entity_id, model_version),
n AS (SELECT article_id, entity_id, model_version, max(CASE WHEN article_id % 7 <> 0 THEN c - 1.5 END) AS n FROM l WHERE c >= 0.93 GROUP BY ALL)
SELECT article_id, entity_id, model_version, CASE WHEN o.article_id IS NOT NULL AND n.article_id IS NOT NULL THEN greatest(coalesce(o, 0), n) WHEN o.article_id IS NOT NULL THEN o ELSE n END AS confidence_score
FROM o FULL JOIN n USING (article_id, entity_id, model_version)
""")
def upsert_max(spark: SparkSession, d: str) -> DataFrame:
    """Old nulls count as 0 against new values, which are negative here; new nulls change nothing else."""
    score = 1 - F.col("l_discount")
    line = parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("entity_id"), F.col("l_linenumber").alias("model_version"), score.alias("confidence_score"))
    keys = ["article_id", "entity_id", "model_version"]
    old = line.where("confidence_score < 0.95").groupBy(*keys).agg(F.max("confidence_score").alias("confidence_score")).withColumn("confidence_score", F.when(F.col("article_id") % 11 != 0, F.col("confidence_score")))
    new = line.where("confidence_score >= 0.93").withColumn("confidence_score", F.when(F.col("article_id") % 7 != 0, F.col("confidence_score") - 1.5))
    return M.merge_max(old, new, keys, "confidence_score")


@_register("""
SELECT event_type, max_by(value, event_id) AS value, CASE WHEN max(event_id) % 2 = 0 THEN max_by(user_id, event_id) END AS user_id, min(CASE WHEN event_id % 2 = 0 THEN ts END) AS created_at FROM events GROUP BY 1
""")
def upsert_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each type replaces what an earlier batch left, nulls too; the time of creation stays."""
    events = parquet(spark, d, "events").select("event_type", "value", "user_id", "event_id", "ts")
    old = events.where("event_id % 2 = 0").groupBy("event_type").agg(F.min("value").alias("value"), F.min("user_id").alias("user_id"), F.min("ts").alias("created_at"))
    new = events.withColumn("user_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id")))
    return M.merge_overwrite(old, new, ["event_type"], ["value", "user_id"], "event_id", "created_at")


@_register("WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 2600)) AS pos FROM documents) SELECT doc_id, CAST(pos / 2600 AS INT) AS chunk, substr(text, pos + 1, 3000) AS body FROM s")
def char_chunks(spark: SparkSession, d: str) -> DataFrame:
    return P.documents(spark, d).select("doc_id", F.posexplode(S.char_chunks(F.col("text"))).alias("chunk", "body"))


@_register("""
WITH d AS (SELECT doc_id, lower(lang) AS lang, NOT coalesce(regexp_matches(text, '[^\\s\\x{85}\\x{a0}\\x{2028}\\x{2029}]'), false) AS blank FROM documents)
SELECT doc_id, CASE WHEN blank THEN 'unk' ELSE lang END AS lang, CASE WHEN blank THEN 0 ELSE 0.75 END::DOUBLE AS score FROM d
WHERE blank OR lang IN ('ar', 'en', 'fr')
""")
def language_routing(spark: SparkSession, d: str) -> DataFrame:
    """The table's ``lang`` stands for a model's best guess; its texts have no Arabic letters."""
    guesses = F.array(F.struct(F.col("lang"), F.lit(0.75).alias("score")), F.struct(F.lit("arz").alias("lang"), F.lit(0.2).alias("score")))
    routed = P.documents(spark, d).select("doc_id", L.routed(F.col("text"), guesses).alias("r")).select("doc_id", "r.lang", "r.score")
    return routed.where(L.accepted(F.col("lang"), F.col("score"), ["ar", "en", "fr"], 0.7) | (F.col("lang") == "unk"))


@_register("""
WITH s AS (SELECT DISTINCT doc_id, start, "end", label, score FROM (SELECT doc_id, 0 AS start, CAST(least(length(text), 5) AS INT) AS "end", 'A' AS label, 0.5::DOUBLE AS score FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, CAST(least(length(text), 5) AS INT), CAST(least(length(text), 9) AS INT), 'A', 0.75::DOUBLE FROM documents WHERE text IS NOT NULL))
SELECT doc_id, min(start) AS first_at, max("end") AS end_at, max(score) AS score FROM s WHERE "end" > start GROUP BY doc_id
""")
def span_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two touching spans of one label at the start of each text, where it is long enough for them."""
    ends = [F.least(F.length("text"), F.lit(n)) for n in (0, 5, 9)]
    spans = F.array(*[F.struct(a.alias("start"), b.alias("end"), F.lit("A").alias("label"), F.lit(x).alias("score")) for a, b, x in ((ends[0], ends[1], 0.5), (ends[1], ends[2], 0.75))])
    spans = F.filter(spans, lambda s: s["end"] > s["start"])
    merged = P.documents(spark, d).where("text is not null").select("doc_id", F.explode(SP.merged(F.col("text"), SP.deduplicated(spans))).alias("s"))
    return merged.select("doc_id", F.col("s.start").alias("first_at"), F.col("s.end").alias("end_at"), "s.score")


@_register("""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\s\\x{85}\\x{a0}\\x{2028}\\x{2029}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, unnest(CASE WHEN len(w) <= 450 THEN [0] ELSE range(0, len(w), 350) END) AS pos FROM w)
SELECT doc_id, CAST(pos / 350 AS INT) AS chunk, CASE WHEN len(w) <= 450 THEN text ELSE array_to_string(w[pos + 1 : pos + 450], ' ') END AS body FROM s
""")
def word_chunks(spark: SparkSession, d: str) -> DataFrame:
    return P.documents(spark, d).where("text is not null").select("doc_id", F.posexplode(S.word_chunks(F.col("text"))).alias("chunk", "body"))


@_register("""
WITH p AS (SELECT conv_id AS doc, role AS label, count(*) AS n, sum(1 / CAST(1 + turn AS DOUBLE)) AS s, min(turn) AS f FROM conversations GROUP BY 1, 2)
SELECT doc, label, n AS votes, n / sum(n) OVER (PARTITION BY doc) AS vote_share, s / n AS mean_score FROM p
QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, s DESC, f) = 1
""")
def chunk_votes(spark: SparkSession, d: str) -> DataFrame:
    votes = parquet(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("chunk"), F.col("role").alias("label"), (1 / (1 + F.col("turn")).cast("double")).alias("score"))
    return A.chunk_votes(votes)


@_register("SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS body FROM pages")
def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "pages").select("page_id", S.without_tags(F.col("html")).alias("body"))


@_register("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\\s\\x{85}\\x{a0}]+', ' ', 'g')) AS body FROM pages")
def collapse_ws(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "pages").select("page_id", S.collapsed(S.without_tags(F.col("html"))).alias("body"))


@_register("SELECT doc_id, CASE WHEN length(replace(text, ' ', '')) > 0 THEN length(regexp_replace(text, '[^\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}]', '', 'g')) / length(replace(text, ' ', '')) ELSE 0 END AS ratio FROM documents")
def arabic_ratio(spark: SparkSession, d: str) -> DataFrame:
    return P.documents(spark, d).select("doc_id", S.share_arabic(F.col("text")).alias("ratio"))


@_register("SELECT lang, count(*) AS docs, sum(CASE WHEN lang IN ('ar', 'en', 'fr') AND doc_id % 9 <> 0 AND doc_id % 4 >= 1 THEN 0 ELSE 1 END)::BIGINT AS skipped FROM documents GROUP BY 1")
def language_filter(spark: SparkSession, d: str) -> DataFrame:
    """Scores differ by id, so that some articles of supported languages are skipped, too."""
    rows = P.documents(spark, d).withColumn("score", F.when(F.col("doc_id") % 9 != 0, (F.col("doc_id") % 4) / 4 + 0.01))
    valid, skipped = E.split_by_language(rows, ["ar", "en", "fr"], 0.26)
    both = valid.withColumn("s", F.lit(0)).unionByName(skipped.withColumn("s", F.lit(1)))
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("s").alias("skipped"))


@_register("SELECT event_type, round_even(avg(value), 4) AS avg_ms_per_doc, round_even(sum(value) / 1000, 6) AS total_inf_time_sec, count(*) AS docs FROM events GROUP BY 1")
def latency_by_group(spark: SparkSession, d: str) -> DataFrame:
    return A.mean_latency(parquet(spark, d, "events"), ["event_type"], "value")


@_register("SELECT event_id, round_even(avg(value) OVER (PARTITION BY event_type, user_id % 10), 4) AS avg_ms_per_doc, round_even(value / 1000, 6) AS total_inf_time_sec FROM events")
def latency_by_article(spark: SparkSession, d: str) -> DataFrame:
    log = parquet(spark, d, "events").withColumn("model", F.col("user_id") % 10)
    return A.with_mean_latency(log, ["event_type", "model"], "value").select("event_id", "avg_ms_per_doc", "total_inf_time_sec")


@_register("SELECT doc_id, length(trim(text)) >= 30 AND len(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) >= 5 AS ready FROM documents WHERE text IS NOT NULL")
def topic_text_gate(spark: SparkSession, d: str) -> DataFrame:
    return P.documents(spark, d).where("text is not null").select("doc_id", S.topic_ready(F.col("text")).alias("ready"))


@_register("SELECT c_custkey, unnest(CASE WHEN c_mktsegment = 'MACHINERY' THEN [8] ELSE [c_nationkey, (c_nationkey + 7) % 25] END)::INT AS country_id FROM customer")
def id_list_explode(spark: SparkSession, d: str) -> DataFrame:
    listed = F.when(F.col("c_mktsegment") != "MACHINERY", F.concat_ws(", ", F.col("c_nationkey").cast("string"), F.lit("x"), ((F.col("c_nationkey") + 7) % 25).cast("string")))
    return parquet(spark, d, "customer").select("c_custkey", F.explode(S.country_ids(listed, 8)).alias("country_id"))


@_register()
def fuzzy_entities(spark: SparkSession, d: str) -> DataFrame:
    names = parquet(spark, d, "part").select(F.col("p_type").alias("entity_type"), F.lower("p_name").alias("normalized_name"), F.col("p_partkey").alias("seq"))
    return M.resolve_fuzzy(names)


@_register()
def entity_ids(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts resolved against those of every third part."""
    part = parquet(spark, d, "part")
    known = part.where("p_partkey % 3 = 0").groupBy(F.col("p_type").alias("entity_type"), F.col("p_name").alias("normalized_name")).agg(F.min("p_partkey").alias("entity_id"))
    mentions = part.select(F.col("p_name").alias("entity_name"), F.when(F.col("p_partkey") % 50 != 0, F.col("p_type")).alias("entity_type"), F.col("p_name").alias("normalized_name"), F.col("p_partkey").alias("seq"))
    return M.get_or_insert(mentions, known)[0]


def _pick(values: list[str | None], key: str) -> Column:
    """One of some fixed values, in turn by ``key``."""
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def _pick_sql(values: list[str | None], key: str) -> str:
    return "CASE " + key + f" % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)) + " END"


_TAGS = ["B-PER", "i-org", "GPE", "O", "person name", "xyzzy", " b-date ", "", None, "I-FOO", "ab", "MISC", "I-Misc", "Software"]
_TYPE_OF = "WHEN 'B-PER' THEN 'PER' WHEN 'I-ORG' THEN 'ORG' WHEN 'GPE' THEN 'LOC' WHEN 'PERSON NAME' THEN 'PER' WHEN 'XYZZY' THEN 'XYZ' WHEN 'B-DATE' THEN 'DAT' WHEN 'UNK' THEN 'UNK' WHEN 'I-FOO' THEN 'FOO' WHEN 'AB' THEN 'AB' WHEN 'MISC' THEN 'MIS' WHEN 'I-MISC' THEN 'MIS' WHEN 'SOFTWARE' THEN 'PRO'"


@_register(f"SELECT p_partkey, CASE t {_TYPE_OF} WHEN 'O' THEN 'O' END AS general, CASE t {_TYPE_OF} END AS of_model FROM (SELECT p_partkey, upper(trim(coalesce(nullif({_pick_sql(_TAGS, 'p_partkey')}, ''), 'UNK'))) AS t FROM part)")
def entity_types(spark: SparkSession, d: str) -> DataFrame:
    """Raw tags by the general map, and by that of a model with its own tags."""
    tag = _pick(_TAGS, "p_partkey")
    return parquet(spark, d, "part").select("p_partkey", R.entity_type(tag).alias("general"), R.entity_type(tag, "dslim/bert-base-NER").alias("of_model"))


_NAMES = [" Ana ", "x", "ـــ", "", None, " ـaـ", "é", "ab"]


@_register(f"SELECT p_partkey, coalesce(length(trim(n)) > 1 AND trim(replace(trim(n), 'ـ', '')) <> '', false) AS is_name FROM (SELECT p_partkey, {_pick_sql(_NAMES, 'p_partkey')} AS n FROM part)")
def name_gate(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "part").select("p_partkey", R.is_name(_pick(_NAMES, "p_partkey")).alias("is_name"))


_HEADS = ["Who knows ", "losses in ", "what? ", "", "Les pertes ", "the COLLAPSE of ", "est-ce "]
_LANG = "CASE WHEN lang IN ('ar', 'fr') THEN lang ELSE 'en' END"
_ASKED = "(t LIKE '%?%' OR CASE WHEN lang = 'fr' THEN lower(w[1]) IN ('qui', 'que', 'quoi', 'pourquoi', 'comment', 'où', 'ou', 'quand', 'quel', 'quelle', 'quels', 'quelles', 'est-ce', 'peut', 'doit') ELSE lower(w[1]) IN ('who', 'what', 'why', 'how', 'where', 'when', 'which', 'is', 'are', 'do', 'does', 'did', 'can', 'could', 'will', 'would') END)"
_CUED = "CASE WHEN lang = 'fr' THEN regexp_matches(lower(t), 'austérité|chômage|sanctions|effondrement|récession|pertes|victimes|catastrophe') ELSE regexp_matches(lower(t), 'austerity|unemployment|sanctions|collapse|recession|losses|casualties|victims|disaster') END"


@_register(f"""
WITH d AS (SELECT doc_id, lang, {_pick_sql(_HEADS, 'doc_id')} || CASE WHEN doc_id % 2 = 0 THEN substr(coalesce(text, ''), 1, 40) ELSE coalesce(text, '') END AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\s\\x{{85}}\\x{{a0}}]+'), lambda x: x <> '') AS w FROM d),
r AS (SELECT doc_id, len(w) > 0 AND (len(w) <= 8 OR length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) <= 60) AND {_ASKED} AS short_question, {_CUED} AS negative_cue, CASE WHEN doc_id % 3 = 0 THEN 'POSITIVE' ELSE 'NEUTRAL' END AS label FROM w)
SELECT doc_id, coalesce(short_question, false) AS short_question, negative_cue, CASE WHEN negative_cue AND label = 'NEUTRAL' THEN 'NEGATIVE' ELSE label END AS label, CASE WHEN negative_cue AND label = 'NEUTRAL' THEN 0.75 ELSE 0.5 END::DOUBLE AS score FROM r
""")
def sentiment_rules(spark: SparkSession, d: str) -> DataFrame:
    """Questions and cues before the documents' texts, every second one cut short."""
    docs = P.documents(spark, d).withColumn("t", F.concat(_pick(_HEADS, "doc_id"), F.when(F.col("doc_id") % 2 == 0, F.substring(F.coalesce("text", F.lit("")), 1, 40)).otherwise(F.coalesce("text", F.lit("")))))
    label = F.when(F.col("doc_id") % 3 == 0, "POSITIVE").otherwise("NEUTRAL")
    safe = R.safe_sentiment(F.col("t"), F.col("lang"), label, F.lit(0.5))
    return docs.select("doc_id", R.is_short_question(F.col("t"), F.col("lang")).alias("short_question"), R.has_negative_cue(F.col("t"), F.col("lang")).alias("negative_cue"), safe.alias("s")).select("doc_id", "short_question", "negative_cue", "s.label", "s.score")


_RAW = ["LABEL_0", "label_1", "LABEL_2", "LABEL_3", "4 stars", "1 étoile", "Negative ", "POS", "mixed", "neutral", "?", "LABEL_9"]
_STARS = "CASE u WHEN 'LABEL_0' THEN 'NEGATIVE' WHEN 'LABEL_1' THEN 'NEGATIVE' WHEN 'LABEL_2' THEN 'NEUTRAL' WHEN 'LABEL_3' THEN 'POSITIVE' WHEN '4 STARS' THEN 'POSITIVE' WHEN '1 ÉTOILE' THEN 'NEGATIVE' WHEN 'NEGATIVE' THEN 'NEGATIVE' WHEN 'POS' THEN 'POSITIVE' ELSE 'NEUTRAL' END"
_THREE = "CASE u WHEN 'LABEL_0' THEN 'NEGATIVE' WHEN 'LABEL_1' THEN 'NEUTRAL' WHEN 'LABEL_2' THEN 'POSITIVE' WHEN 'NEGATIVE' THEN 'NEGATIVE' WHEN 'POS' THEN 'POSITIVE' ELSE 'NEUTRAL' END"


@_register(f"SELECT p_partkey, {_STARS} AS stars, {_THREE} AS three, CASE u WHEN 'NEGATIVE' THEN 'NEGATIVE' WHEN 'POS' THEN 'POSITIVE' ELSE 'NEUTRAL' END AS other FROM (SELECT p_partkey, upper(trim({_pick_sql(_RAW, 'p_partkey')})) AS u FROM part)")
def sentiment_labels(spark: SparkSession, d: str) -> DataFrame:
    """Raw labels as two known models and an unknown one mean them."""
    raw = _pick(_RAW, "p_partkey")
    names = {"stars": "cmarkea/distilcamembert-base-sentiment", "three": "cardiffnlp/twitter-roberta-base-sentiment-latest", "other": "some/model"}
    return parquet(spark, d, "part").select("p_partkey", *[R.sentiment_of(raw, model).alias(name) for name, model in names.items()])


_ANSWERS = ['{"response": "thinking\\ntrue_prediction: Sports\\nmore"}', '{"response": "TRUE_PREDICTION:  Politique "}', '{"response": "true_prediction: positive."}', '{"response": "no idea"}', '{"error": "x"}', "no json", '{"response": "true_prediction: Général"}']
_LANGS = ["en", "fr", "de"]


@_register(f"""
WITH a AS (SELECT p_partkey, {_pick_sql(_LANGS, 'p_partkey')} AS lang, CASE WHEN json_valid(a) THEN json_extract_string(a, '$.response') END AS answer FROM (SELECT p_partkey, {_pick_sql([x.replace(chr(10), chr(92) + 'n') for x in _ANSWERS], 'p_partkey')} AS a FROM part)),
p AS (SELECT *, coalesce(trim(regexp_extract(answer, '(?i)true_prediction:\\s*(.*)', 1)), '') AS topic, upper(regexp_extract(answer, '(?i)true_prediction:\\s*(\\w+)', 1)) AS word FROM a)
SELECT p_partkey, answer, CASE WHEN word IN ('POSITIVE', 'NEGATIVE', 'NEUTRAL') THEN word END AS sentiment,
  CASE WHEN lang = 'fr' THEN CASE WHEN topic IN ('Politique', 'Général') THEN topic ELSE 'Général' END WHEN topic = 'Sports' THEN topic ELSE 'General' END AS topic,
  CASE WHEN (lang = 'fr' AND topic IN ('Politique', 'Général')) OR (lang <> 'fr' AND topic = 'Sports') THEN 1 ELSE 0 END::DOUBLE AS score FROM p
""")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Replies of a generation server: the answer within, the sentiment and the topic that it names."""
    reply = parquet(spark, d, "part").select("p_partkey", _pick(_LANGS, "p_partkey").alias("lang"), R.answer_text(_pick(_ANSWERS, "p_partkey")).alias("answer"))
    topic = R.answered_topic(F.col("answer"), F.col("lang"))
    return reply.select("p_partkey", "answer", R.answered_sentiment(F.col("answer")).alias("sentiment"), topic.alias("t")).select("p_partkey", "answer", "sentiment", F.col("t.label").alias("topic"), "t.score")


_DATES = ["2020-03-15 10:00:00", "2020-02-30", "bad", "", None, "1999-12-31"]


@_register(f"""
WITH s AS (SELECT p_partkey, try_cast({_pick_sql(_DATES, 'p_partkey')} AS TIMESTAMP) AS t, 1895 + p_partkey % 210 AS y, p_partkey % 15 AS m, CASE WHEN p_partkey % 4 = 0 THEN 'x' WHEN p_partkey % 4 = 1 THEN 'NaN' ELSE p_partkey::VARCHAR END AS v FROM part)
SELECT p_partkey, coalesce(t, CASE WHEN m BETWEEN 1 AND 12 AND y BETWEEN 1900 AND 2100 THEN make_timestamp(y, m, 1, 0, 0, 0) END)::DATE AS day, date_trunc('month', coalesce(t, CASE WHEN m BETWEEN 1 AND 12 AND y BETWEEN 1900 AND 2100 THEN make_timestamp(y, m, 1, 0, 0, 0) END))::DATE AS month,
  CASE WHEN p_partkey % 4 < 2 THEN 0 ELSE p_partkey END::BIGINT AS n FROM s
""")
def dates_and_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Dates that are none, with plausible years and months and others; numbers that are none."""
    key, when = F.col("p_partkey"), _pick(_DATES, "p_partkey")
    year, month = 1895 + key % 210, key % 15
    value = F.when(key % 4 == 0, "x").when(key % 4 == 1, "NaN").otherwise(key.cast("string"))
    return parquet(spark, d, "part").select("p_partkey", F.to_date(S.effective_date(when, year, month)).alias("day"), S.month_start(when, year, month).alias("month"), S.number_or_zero(value, "long").alias("n"))


@_register("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html || ' see HTTPS://a.b/c, www.x.y httpx a.b@c.d end', '<[^>]+>', ' ', 'g'), '(?i)https?://[^\\s\\x{85}\\x{a0}]+', ' ', 'g'), '(?i)www\\.[^\\s\\x{85}\\x{a0}]+', ' ', 'g'), '(?i)(?:https?|htt)[^\\s\\x{85}\\x{a0}]+', ' ', 'g'), '[^\\s\\x{85}\\x{a0}]+@[^\\s\\x{85}\\x{a0}]+', ' ', 'g') AS body FROM pages")
def links_removed(spark: SparkSession, d: str) -> DataFrame:
    body = S.without_tags(F.concat("html", F.lit(" see HTTPS://a.b/c, www.x.y httpx a.b@c.d end")))
    return parquet(spark, d, "pages").select("page_id", S.without_links(body).alias("body"))


@_register("""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x{85}\\x{a0}\\x{2028}\\x{2029}]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(w) AS words, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]'))) >= 3 AND (length(replace(t, ' ', '')) = 0 OR length(regexp_replace(t, '\\P{L}', '', 'g')) / length(replace(t, ' ', '')) >= 0.3) AS latin FROM w
""")
def latin_gate(spark: SparkSession, d: str) -> DataFrame:
    return P.documents(spark, d).select("doc_id", F.size(R.words_of(F.col("text"))).cast("long").alias("words"), R.is_latin_text(F.col("text")).alias("latin"))


@_register("""
WITH v AS (SELECT conv_id AS doc, turn, CASE turn % 4 WHEN 0 THEN 'NEUTRAL' WHEN 1 THEN 'POSITIVE' WHEN 2 THEN 'NEGATIVE' ELSE 'other' END AS label FROM conversations WHERE conv_id % 5 <> 0 UNION ALL SELECT conv_id, turn, 'other' FROM conversations WHERE conv_id % 5 = 0),
p AS (SELECT doc, label, count(*) AS n, sum(0.5::DOUBLE) AS s, list_position(['POSITIVE', 'NEGATIVE', 'NEUTRAL'], label) AS f FROM v WHERE label <> 'other' GROUP BY 1, 2),
b AS (SELECT doc, label, n AS votes, n / sum(n) OVER (PARTITION BY doc) AS vote_share, s / n AS mean_score FROM p QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, s DESC, f) = 1)
SELECT d.doc, coalesce(label, 'UNK') AS label, coalesce(votes, 0) AS votes, coalesce(vote_share, 0)::DOUBLE AS vote_share, coalesce(mean_score, 0)::DOUBLE AS mean_score FROM (SELECT DISTINCT doc FROM v) d LEFT JOIN b ON d.doc = b.doc
""")
def ordered_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes whose ties go by the order of sentiments; labels that are none don't count."""
    turn = F.col("turn") % 4
    label = F.when(F.col("conv_id") % 5 == 0, "other").when(turn == 0, "NEUTRAL").when(turn == 1, "POSITIVE").when(turn == 2, "NEGATIVE").otherwise("other")
    votes = parquet(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("chunk"), label.alias("label"), F.lit(0.5).alias("score"))
    return A.chunk_votes(votes, V.SENTIMENTS)


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return P.documents(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("body"), "lang")


@_register("""
WITH a AS (SELECT doc_id, lang, NOT coalesce(regexp_matches(text, '[^\\s\\x{85}\\x{a0}\\x{2028}\\x{2029}]'), false) AS blank FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic <> 1 AND quality IS NOT NULL))
SELECT doc_id AS article_id, CASE WHEN lang IN ('en', 'fr') AND NOT blank THEN lang END AS language, CASE WHEN lang IN ('en', 'fr') AND NOT blank THEN NULL ELSE 'SKIPPED' END AS sentiment_label FROM a
""")
def enrichment_rows(spark: SparkSession, d: str) -> DataFrame:
    """What one pass over new articles leaves in the sentiment table: skipped ones, and waiting ones with their
    language. The table's ``lang`` stands for a model's guess."""
    done = parquet(spark, d, "labels").select(F.col("doc_id").alias("article_id"), F.when(F.col("toxic") != 1, F.col("quality")).alias("sentiment_label"))
    guess = lambda _: F.array(F.struct(F.col("lang_guess").alias("lang"), F.lit(0.75).alias("score")))
    found = E.enrich(_articles(spark, d).withColumnRenamed("lang", "lang_guess"), done, guess)
    return found.rows["article_sentiments"]


@_register()
def cleaned_texts(spark: SparkSession, d: str) -> DataFrame:
    return P.documents(spark, d).withColumn("t", C.three_texts(F.col("text"), F.col("lang"))).select("doc_id", "t.*")


@_register()
def detection_texts(spark: SparkSession, d: str) -> DataFrame:
    return P.documents(spark, d).select("doc_id", C.detection_text(F.col("text")).alias("text_langdetect"))


@_register()
def scored_sentiments(spark: SparkSession, d: str) -> DataFrame:
    rows = P.documents(spark, d).select(F.col("doc_id").alias("doc"), "lang", F.col("text").alias("text_sentiment"))
    return G.sentiments(rows, G.CueSentiment, "cues")


@_register()
def scored_topics(spark: SparkSession, d: str) -> DataFrame:
    rows = P.documents(spark, d).select(F.col("doc_id").alias("doc"), "lang", F.col("text").alias("text_topic"))
    return G.topics(rows, G.NamedTopic)


@_register()
def tagged_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = P.documents(spark, d).select(F.col("doc_id").alias("doc"), "lang", F.col("text").alias("text_ner"))
    return G.found_entities(rows, G.CapitalTagger, "capitals")


def _summary_sql() -> str:
    peaks = _peaks_sql(6, 1.5)
    month, country = (f"SELECT * FROM ({rows})" for rows in (_BY_MONTH, _BY_COUNTRY))
    kpi = "'OVERVIEW_METRICS' AS section, {} AS period_or_scope, 'KPI' AS category, '{}' AS item_name, {} AS metric_count, NULL::DOUBLE AS metric_share_or_score, {} AS details"
    span = "(min(year_month) || ' -> ' || max(year_month))"
    lines = [
        ("_t", span, "Active Date Range (Months)", "count(DISTINCT year_month)", f"'Covered time span: ' || {span} || ' (' || count(DISTINCT year_month) || ' monthly intervals)'"),
        ("(SELECT DISTINCT year_month, total_articles_in_month AS n FROM _t)", "'All Available'", "Total Processed Articles in Analytics", "sum(n)::BIGINT", "'Cumulative volume across analyzed monthly buckets: ' || format('{:,}', sum(n)::BIGINT) || ' articles'"),
        ("_t", "'All Available'", "Distinct Topic Categories", "count(DISTINCT topic_label)", "'Total distinct topic labels classified: ' || count(DISTINCT topic_label)"),
        ("_p", "'All Available'", "Topic Surges Detected (Z >= 2.5)", "count(*)", "'Detected anomaly spikes in topic share: ' || count(*) || ' occurrences'"),
        ("_m", "'All Available'", "Top Unique Named Entities", "count(DISTINCT normalized_name)", "'Total distinct top entity entries tracked across months: ' || count(DISTINCT normalized_name)"),
    ]
    pct = lambda c: f"printf('%.1f', 100 * {c}) || '%'"
    ranked = lambda section, where, rank, table: f"SELECT '{section}', {where}, 'ENTITY_' || entity_type, normalized_name, distinct_articles_count, round_even(mean_confidence, 4), 'Rank #' || {rank} || ' in ' || {where} || ' (' || distinct_articles_count || ' articles, ' || mentions_count || ' mentions, conf: ' || printf('%.3f', mean_confidence) || ')' FROM {table} WHERE {rank} <= 5"
    parts = [f"SELECT {kpi.format(period, item, n, details)} FROM {table}" for table, period, item, n, details in lines]
    parts += [
        f"SELECT 'DOMINANT_TOPICS_BY_MONTH', year_month, 'TOPIC', dominant_topic, dominant_articles_count, dominant_topic_share, 'Dominant topic in ' || year_month || ' (' || dominant_articles_count || '/' || total_articles_in_month || ' articles, ' || {pct('dominant_topic_share')} || ' share)' FROM ({_DOMINANT})",
        f"SELECT 'TOPIC_SURGES_PEAKS', year_month, 'TOPIC_PEAK', topic_label, articles_count, z_score, 'Spike Z=' || printf('%.2f', z_score) || ' (Share: ' || {pct('topic_share')} || ' vs rolling avg: ' || {pct('roll_mean')} || ', Count: ' || articles_count || ')' FROM _p",
        ranked("TOP_ENTITIES_BY_MONTH", "year_month", "rank_in_month", "_m"),
        ranked("TOP_ENTITIES_BY_COUNTRY", "label_en", "rank_in_country", "_c"),
        f"SELECT 'MODEL_COMPARISON', upper(language), 'AGREEMENT_' || upper(task), upper(task[1]) || task[2:] || ' Agreement (BERT vs Qwen)', total_samples, cohen_kappa, 'Scope: ' || upper(language) || ' | Accuracy: ' || {pct('accuracy')} || ' (' || agreement_count || '/' || total_samples || ') | Cohen''s Kappa: ' || printf('%.3f', cohen_kappa) FROM ({_METRICS})",
    ]
    return f"WITH _t AS ({_TOPICS}), _p AS (SELECT * FROM ({peaks})), _m AS ({month}), _c AS ({country}) " + " UNION ALL ".join(parts)


@_register(_summary_sql())
def analytics_summary(spark: SparkSession, d: str) -> DataFrame:
    """The months' topics are few rows that four sections read: they are kept in memory."""
    topics = _topics(spark, d).cache()
    per = _per_article(spark, d)
    months, countries = A.entities_by_month(per, P.dated_articles(spark, d)), A.top_entities_by_country(per, P.placed_articles(spark, d), P.country(spark, d))
    metrics, _ = A.model_comparison(P.sentiment_pairs(spark, d), P.topic_pairs(spark, d))
    return A.summary(topics, A.topic_peaks(topics, 6, 1.5), months, countries, metrics)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
