"""Dates, chunks, rules, spans, votes, kappa, latency, reports: hand-made rows."""

import datetime as dt
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from presswork.functions import rules, scalars, spans, vocabulary
from presswork.operators import analytics as A
from presswork.operators import reports, scoring
from presswork.sources import tables


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


@pytest.mark.parametrize(("n", "windows"), [(0, 1), (1, 1), (449, 1), (450, 1), (451, 2), (750, 3), (800, 3), (1100, 4)])
def test_word_windows(spark, n, windows):
    words = [f"w{i}" for i in range(n)]
    got = one(spark, " ".join(words)).select(scalars.word_chunks(F.col("x"))).first()[0]
    want = [" ".join(words)] if n <= 450 else [" ".join(words[a : a + 450]) for a in range(0, n, 350)]
    assert got == want and len(got) == windows


@pytest.mark.parametrize(("n", "chunks"), [(0, 0), (1, 1), (2600, 1), (2601, 2), (2700, 2), (3000, 2), (3001, 2), (5200, 2), (5201, 3)])
def test_char_chunks(spark, n, chunks):
    text = "ab" * (n // 2) + "a" * (n % 2)
    got = one(spark, text).select(scalars.char_chunks(F.col("x"))).first()[0]
    assert got == [text[a : a + 3000] for a in range(0, n, 2600)] and len(got) == chunks


def test_months(spark):
    rows = [("2020-03-15 10:00:00", 1999, 1), ("bad", 2020, 5), (None, 2020, 13), (None, 1899, 5), (None, 2100, 12), (None, None, 3), ("", 2020, 0)]
    df = spark.createDataFrame(rows, "d string, y int, m int")
    got = [r[0] for r in df.select(scalars.month_start(F.col("d"), F.col("y"), F.col("m"))).collect()]
    assert got == [dt.date(2020, 3, 1), dt.date(2020, 5, 1), None, None, dt.date(2100, 12, 1), None, None]
    stamp = one(spark, dt.datetime(2021, 2, 3, 4), "timestamp")
    assert stamp.select(scalars.month_start(F.col("x"), kind="timestamp")).first()[0] == dt.date(2021, 2, 1)
    assert stamp.select(scalars.effective_date(F.col("x"), kind="timestamp")).first()[0] == dt.datetime(2021, 2, 3, 4)


def test_country_lists(spark):
    df = spark.createDataFrame([("8, x,,12",), ("null",), ("nan",), ("",), (None,), ("3",)], "x string")
    assert [r[0] for r in df.select(scalars.country_ids(F.col("x"), 8)).collect()] == [[8, 12], [8], [8], [8], [8], [3]]


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_fixed_like_printf(spark, digits):
    values = [0.0625, 6.25, 23.15, 23.35, 23.45, 0.7375, 0.6525, 99.95, -0.0004, 0.0, 2.0625, 0.05, 1.005, 999.9996, 12.5] + [i / 10000 * 100 for i in range(0, 10000, 37)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(scalars.fixed(F.col("x"), digits)).collect()] == [f"{v:.{digits}f}" for v in values]


def test_answers_and_links(spark):
    df = one(spark, "so\nTrue_Prediction:   Sports club \nmore")
    assert tuple(df.select(scalars.predicted_label(F.col("x"), True), scalars.predicted_label(F.col("x"), False)).first()) == ("Sports", "Sports club")
    text = one(spark, "a HTTP://x.y/z b www.q.r c httpfoo d m@n.o e")
    assert text.select(F.regexp_replace(scalars.without_links(F.col("x")), " +", " ")).first()[0] == "a b c d e"


def test_rules(spark):
    rows = [("Who came?", "en", True, False), ("who came", "en", True, False), ("he came", "en", False, False), ("est-ce vrai", "fr", True, False), ("Les pertes", "fr", False, True), ("glosses", "en", False, True), ("هل ضحايا", "ar", True, True), ("what " + "x" * 70 + " a b c d e f g h", "en", False, False), (None, None, False, False), ("", "en", False, False)]
    df = spark.createDataFrame(rows, "t string, lang string, q boolean, cue boolean")
    got = df.select("q", "cue", rules.is_short_question(F.col("t"), F.col("lang")).alias("a"), rules.has_negative_cue(F.col("t"), F.col("lang")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(r.q, r.cue) for r in got]
    topic = spark.createDataFrame([("Sport", "fr"), ("Sport", "en"), ("x", "ar"), (None, None)], "p string, lang string")
    got = [tuple(r[0]) for r in topic.select(rules.checked_topic(F.col("p"), F.col("lang"))).collect()]
    assert got == [("Sport", 1.0), ("General", 0.0), ("عام", 0.0), ("General", 0.0)]


def test_prompts_hold_all_choices(spark):
    df = spark.createDataFrame([("fr", "le texte")], "lang string, t string")
    topic, mood = df.select(rules.topic_prompt(F.col("lang"), F.col("t")), rules.sentiment_prompt(F.col("lang"), F.col("t"))).first()
    assert all(name in topic for names in vocabulary.TOPICS.values() for name in names) and "French" in topic and "le texte" in topic
    assert all(s in mood for s in vocabulary.SENTIMENTS) and mood.count("true_prediction:") == topic.count("true_prediction:") == 1


def test_vocabularies():
    assert len(vocabulary.entity_tags()) == 97
    assert {len(names) for names in vocabulary.TOPICS.values()} == {18}
    assert vocabulary.model_tags("x/BERT-base-NER")["I-MISC"] == "MIS" and vocabulary.model_tags("gliner") is None
    assert (vocabulary.chunk_tokens(512), vocabulary.chunk_tokens(10)) == (450, 16)
    assert vocabulary.ZERO_SHOT_LABELS[0] == "person name" and len(vocabulary.ZERO_SHOT_LABELS) == 7


def test_entities(spark):
    text = "In Paris, Mr. Jo met the U N of Lyon - ok ـــ end"
    at = lambda part, label, score: (text.index(part), text.index(part) + len(part), label, score)
    raw = [at("ari", "B-LOC", 0.9), at("Jo", "PER", 0.7), at("Jo", "PER", 0.8), at("U N", "ORG", 0.5), at("Lyon", "LOC", 0.95), at("ok", "ORG", 0.9), at("ـــ", "ORG", 0.9), at("met", "O", 0.99), (40, 400, "LOC", 0.9), at("Mr", "PER", 0.61)]
    df = spark.createDataFrame([(text, raw), (text, []), (None, None)], "t string, raw array<struct<start:int,end:int,label:string,score:double>>")
    rows = df.select(spans.entities(F.col("t"), F.col("raw"), "dslim/bert-base-ner").alias("e")).collect()
    got = [(s.text, s.label, s.score) for s in rows[0].e]
    assert got == [("Paris", "LOC", 0.9), ("Mr. Jo", "PER", 0.8), ("Lyon", "LOC", 0.95)]
    assert [rows[1].e, rows[2].e] == [[], []]
    zero = df.limit(1).select(spans.zero_shot_entities(F.col("raw"))).first()[0]
    assert [s.label for s in zero].count("PER") == 2 and all(s.score >= 0.6 for s in zero)


def test_many_spans_like_one_by_one(spark):
    """More spans than a chunk holds, joined and overlapping: as a plain loop would."""
    import random

    rng = random.Random(5)
    text = "".join(rng.choice("ab, .x") for _ in range(6000))
    raw = sorted({(s := rng.randrange(5990), s + rng.randint(1, 9), rng.choice("AB"), rng.choice([0.5, 0.7, 0.9])) for _ in range(900)})
    want = []
    for s in raw:
        if want and s[0] < want[-1][1]:
            last = want[-1]
            if not (last[3] > s[3] or (last[3] == s[3] and last[1] - last[0] >= s[1] - s[0])):
                want[-1] = s
        elif want and want[-1][2] == s[2] and all(c in spans.GAP_CHARS for c in text[want[-1][1] : s[0]]):
            want[-1] = (want[-1][0], s[1], s[2], max(want[-1][3], s[3]))
        else:
            want.append(s)
    df = spark.createDataFrame([(text, raw)], f"t string, s {spans.SPANS}")
    assert [tuple(x) for x in df.select(spans.merged(F.col("t"), F.col("s"))).first()[0]] == want


def test_windows():
    assert scoring.windows([(0, 1), (2, 3), (4, 5)], 2, 1) == [(0, 3), (2, 5)]
    assert scoring.windows([], 2, 1) == [] and scoring.windows([(3, 3), (4, 6)], 1, 0) == [(4, 6)]
    assert scoring.windows([(i, i + 1) for i in range(1000)], 450, 100) == [(0, 450), (350, 800), (700, 1000)]


def test_token_chunks(spark):
    df = spark.createDataFrame([("aa b  cc",), ("",), (None,)], "x string")
    got = [[tuple(c) for c in r[0]] for r in df.select(scoring.token_chunks(F.col("x"), 2, 1)).collect()]
    assert got == [[("aa b", 0), ("b  cc", 3)], [], []]
    with pytest.raises(ValueError):
        scoring.token_chunks(F.col("x"), 5, 5)


def test_votes(spark):
    votes = [(1, 0, "NEUTRAL", 0.9), (1, 1, "NEGATIVE", 0.1), (1, 2, "NEGATIVE", 0.1), (2, 0, "NEUTRAL", 0.5), (2, 1, "POSITIVE", 0.5), (3, 0, "odd", 0.9), (3, 1, None, 0.9), (4, 0, "NEUTRAL", 0.4), (4, 1, "NEGATIVE", 0.6), (4, 2, "odd", 1.0)]
    df = spark.createDataFrame(votes, "doc int, chunk int, label string, score double")
    got = {r.doc: (r.label, r.vote_share) for r in A.chunk_votes(df, vocabulary.SENTIMENTS).collect()}
    assert got == {1: ("NEGATIVE", 2 / 3), 2: ("POSITIVE", 0.5), 3: ("UNK", 0.0), 4: ("NEGATIVE", 0.5)}
    first = {r.doc: r.label for r in A.chunk_votes(df).collect()}
    assert first[2] == "NEUTRAL" and first[3] == "odd"


def test_scorers(spark):
    rows = [(1, "en", "losses and sanctions " * 10), (2, "en", "who?"), (3, "fr", None), (4, "en", "plain words, said at length for nobody to mind at all, and so on"), (5, "en", "")]
    df = spark.createDataFrame(rows, "doc int, lang string, text_sentiment string")
    got = {r.doc: (r.label, r.score) for r in scoring.sentiments(df, scoring.CueSentiment, "cues").collect()}
    assert got == {1: ("NEGATIVE", 1.0), 2: ("NEUTRAL", 0.6), 3: ("UNK", 0.0), 4: ("NEUTRAL", 1.0), 5: ("UNK", 0.0)}
    named = spark.createDataFrame([(1, "en", "Sports and sports and Health, told in many words here"), (2, "fr", "court"), (3, "ar", None)], "doc int, lang string, text_topic string")
    assert {r.doc: r.label for r in scoring.topics(named, scoring.NamedTopic).collect()} == {1: "Sports", 2: "Général", 3: "عام"}


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Answers:
    """A generation server that answers, fails, or talks nonsense, by what it is asked."""

    def __init__(self, lang):
        self.server = scoring.ServerScorer("", "m", tries=2, pause=0, post=self.post)

    def post(self, payload):
        if "fail" in payload["prompt"]:
            raise OSError
        return '{"response": "true_prediction: %s"}' % ("positive" if "sentiment" in payload["prompt"] else "Sports" if "ball" in payload["prompt"] else "Cooking")

    def __call__(self, texts):
        return self.server(texts)


def test_asked_models(spark):
    rows = [(1, "en", "a ball game that goes on for a while and then some more"), (2, "en", "to fail is what this text does, again and again and again"), (3, "en", "some other long text that tells of nothing in particular")]
    df = spark.createDataFrame(rows, "doc int, lang string, t string")
    assert {r.doc: (r.label, r.score) for r in scoring.asked_topics(df, Answers, "t").collect()} == {1: ("Sports", 1.0), 2: ("General", 0.0), 3: ("General", 0.0)}
    assert {r.doc: r.label for r in scoring.asked_sentiments(df, Answers, "t").collect()} == {1: "POSITIVE", 2: "UNK", 3: "POSITIVE"}


def kappa(spark, pairs):
    df = spark.createDataFrame([("en", a, b) for a, b in pairs], "language string, a string, b string")
    rows = A.agreement(A.confusion(df, "sentiment", upper=True)).where("language = 'ALL'").collect()
    return rows[0].cohen_kappa if rows else None


def test_kappa(spark):
    assert kappa(spark, [("a", "A ")] * 3) == 1.0
    assert kappa(spark, [("a", "b")] * 3) == 0.0
    assert kappa(spark, [("a", "a"), ("b", "b")]) == 1.0
    assert kappa(spark, [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")]) == 0.0
    assert kappa(spark, [("SKIPPED", "a"), (None, "b")]) is None


def test_skipped_topics_and_missing_columns(spark):
    day = dt.datetime(2020, 1, 5)
    facts = spark.createDataFrame([(1, "SKIPPED", day), (2, " A ", day), (2, "A", day), (3, None, day), (4, "A", None)], "article_id int, topic_label string, crawl_date timestamp")
    got = {r.topic_label: (r.articles_count, r.total_articles_in_month) for r in A.topics_by_month(facts).collect()}
    assert got == {"SKIPPED": (1, 2), "A": (1, 2)}
    assert [r.topic_label for r in A.topics_by_month(facts, exclude_skipped=True).collect()] == ["A"]
    assert A.topic_peaks(facts).count() == 0 and A.topic_peaks(facts).columns == [c.split()[0] for c in A.PEAKS.split(", ")]


def test_peaks_without_the_current_month(spark):
    share = [0.5, 0.4, 0.5, 0.6, 0.5, 0.9]
    rows = [(f"2020-{m:02d}", t, int(round(100 * (s if t == "a" else 1 - s))), 100, 0.0) for m, s in enumerate(share, 1) for t in "ab"]
    df = spark.createDataFrame(rows, "year_month string, topic_label string, articles_count long, total_articles_in_month long, topic_share double")
    assert A.topic_peaks(df).count() == 0  # z can't exceed 2.041 with the month in its own window of 6
    (peak,) = A.topic_peaks(df, exclude_current=True).collect()
    assert (peak.year_month, peak.topic_label, peak.z_score) == ("2020-06", "a", 5.657)


def test_report_orders(spark, medium):
    from presswork.plans import catalogue as K

    topics = [(r.year_month, -r.articles_count, r.topic_label) for r in A.topics_in_order(K.queries()["topics_by_month"](spark, medium)).collect()]
    assert topics == sorted(topics)
    peaks = [(-r.z_score, r.year_month, r.topic_label) for r in A.peaks_in_order(K.queries()["topic_peaks_w6_z15"](spark, medium)).collect()]
    assert peaks == sorted(peaks) and len(peaks) == 18
    scopes = [(r.task, r.language) for r in A.scopes_in_order(K.queries()["model_comparison"](spark, medium)).collect()]
    assert scopes == [("sentiment", s) for s in ("ALL", "a", "n", "r", "unknown")] + [("topic", s) for s in ("ALL", "a", "n", "r")]


def test_reports(spark, tmp_path):
    day = dt.datetime(2020, 1, 5)
    made = {
        "article": spark.createDataFrame([(1, day, None, None, "1,2"), (2, None, 2020, 2, None)], "id long, crawl_date timestamp, year int, month int, id_countries string"),
        "country": spark.createDataFrame([(1, "One"), (8, " nan ")], "id int, label_en string"),
        "article_topics": spark.createDataFrame([(1, "en", "A"), (2, "en", "B")], "article_id long, language string, topic_label string"),
        "article_sentiments": spark.createDataFrame([(1, "en", "POSITIVE")], "article_id long, language string, sentiment_label string"),
        "entities": spark.createDataFrame([(7, "per", " ana "), (8, "", "x"), (9, "ORG", "nan")], "entity_id long, entity_type string, normalized_name string"),
        "article_entities": spark.createDataFrame([(1, 7, 0, 0.5), (1, 7, 1, 0.75), (2, 7, 0, None), (2, 8, 0, 0.9), (2, 9, 0, 0.9)], "article_id long, entity_id long, model_version int, confidence_score double"),
    }
    for name, df in made.items():
        df.write.parquet(f"{tmp_path}/in/{name}.parquet")
    counts = reports.analytics_reports(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/csv")
    assert counts == {"analytics_topics_by_month": 2, "analytics_topic_peaks": 0, "analytics_entities_by_month": 2, "analytics_top_entities_by_country": 3, "model_comparison_metrics": 0, "model_comparison_confusion": 0, "analytics_summary": 12}
    assert sorted(p.name for p in (tmp_path / "csv").iterdir()) == ["analytics_summary.csv"]
    top = tables.relation(spark, f"{tmp_path}/out", "analytics_top_entities_by_country").orderBy("country_id").collect()
    assert [(r.id, r.country_id, r.distinct_articles_count, r.mentions_count, r.mean_confidence) for r in top] == [(1, 1, 1, 2, 0.75), (2, 2, 1, 2, 0.75), (3, 8, 1, 1, None)]
    text = (tmp_path / "csv" / "analytics_summary.csv").read_text("utf-8-sig")
    assert "2020-01 -> 2020-02" in text and "Country ID 8" in text and "Rank #1 in One (1 articles, 2 mentions, conf: 0.750)" in text


class Classifier:
    def __init__(self, lang):
        self.inner = scoring.ZeroShotTopic(lang, lambda texts, names, sentence: [(names[9], 0.5) if "{}" in sentence and len(names) == 18 else None for _ in texts])

    def __call__(self, texts):
        return self.inner(texts)


class Persons:
    def __init__(self, lang):
        pass

    def __call__(self, texts):
        return [[(t.index("Jo"), t.index("Jo") + 2, "person name", 0.9), (0, 1, "person name", 0.9), (0, 4, "date or time expression", 0.5)] if "Jo" in t else [] for t in texts]


def test_zero_shot_models(spark):
    df = spark.createDataFrame([(1, "fr", "un texte de presse assez long pour avoir un thème")], "doc int, lang string, t string")
    assert scoring.topics(df, Classifier, "t").first().label == "Sport"
    long = spark.createDataFrame([(1, "en", "a " * 500 + "Jo and so on " + "b " * 300 + "Jo"), (2, "en", "nobody"), (3, "en", None)], "doc int, lang string, t string")
    got = sorted((r.doc, r.start, r.label, r.text) for r in scoring.zero_shot_found(long, Persons, "t").collect())
    assert got[0] == (1, 1000, "PER", "Jo") and {g[3] for g in got} == {"Jo"}
