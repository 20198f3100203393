"""Merges, ids, enrichment, tables and incremental runs: hand-made rows and plain Python."""

import difflib

import pytest
from pyspark.sql import functions as F

from presswork.operators import enrichment as E
from presswork.operators import merging as M
from presswork.sources import schemas, tables
from presswork.streaming.incremental import run_available

OLD = [(1, "en", "A", 0.5, "x"), (2, None, "B", None, "y"), (3, "fr", None, 0.0, "z")]
COLUMNS = "id int, lang string, label string, score double, extra string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge_coalesce_twice_is_once(spark):
    old = spark.createDataFrame(OLD, COLUMNS)
    batch = spark.createDataFrame([(2, "ar", None, 1), (1, None, "C", 2), (1, None, "D", 1), (4, None, "E", 1), (3, None, None, 1)], "id int, lang string, label string, seq int")
    once = M.merge_coalesce(old, batch, ["id"], ["lang", "label"], "seq")
    assert once.columns == old.columns
    want = [(1, "en", "C", 0.5, "x"), (2, "ar", "B", None, "y"), (3, "fr", None, 0.0, "z"), (4, None, "E", None, None)]
    assert rows(once) == want == rows(M.merge_coalesce(once, batch, ["id"], ["lang", "label"], "seq"))
    assert rows(M.merge_coalesce(old, batch.where("false"), ["id"], ["lang", "label"], "seq")) == sorted(OLD, key=str)


def test_merge_max(spark):
    old = spark.createDataFrame(OLD, COLUMNS)
    batch = spark.createDataFrame([(1, 0.25), (1, 0.4), (2, -2.0), (3, None), (4, -1.0), (5, None), (6, 0.5), (6, 0.75)], "id int, score double")
    got = M.merge_max(old, batch, ["id"], "score")
    assert {r.id: (r.score, r.extra) for r in got.collect()} == {1: (0.5, "x"), 2: (0.0, "y"), 3: (0.0, "z"), 4: (-1.0, None), 5: (None, None), 6: (0.75, None)}


def test_merge_overwrite(spark):
    old = spark.createDataFrame([(1, 0.5, 2.0, None)], "id int, a double, b double, made timestamp")
    batch = spark.createDataFrame([(1, 0.7, None, 1), (1, None, 3.0, 2), (2, 1.0, 1.0, 1)], "id int, a double, b double, seq int")
    got = {r.id: r for r in M.merge_overwrite(old, batch, ["id"], ["a", "b"], "seq", "made").collect()}
    assert (got[1].a, got[1].b, got[1].made) == (None, 3.0, None) and got[2].a == 1.0 and got[2].made is not None


def test_frequencies_and_ids(spark):
    entities = spark.createDataFrame([(1, 5), (2, 7)], "entity_id int, frequency long")
    links = spark.createDataFrame([(1,), (1,), (9,)], "entity_id int")
    assert rows(M.refresh_frequency(entities, links)) == [(1, 2), (2, 7)]
    new = spark.createDataFrame([(f"n{i % 300}", "T") for i in range(500)], "name string, type string")
    ids = M.with_ids(new, ["name", "type"], 40).collect()
    assert sorted(r.entity_id for r in ids) == list(range(41, 341)) and len({r.name for r in ids}) == 300
    assert M.with_ids(new.where("false"), ["name"], 40).count() == 0


def test_unprocessed(spark):
    articles = spark.createDataFrame([(i, None if i == 3 else "b") for i in range(6)], "id long, body string")
    done = spark.createDataFrame([(1, "A"), (2, None)], "article_id long, label string")
    assert [r.id for r in M.unprocessed(articles, done, "label", newest=3).collect()] == [5, 4, 2]
    assert sorted(r.id for r in M.unprocessed(articles, done, "label").collect()) == [0, 2, 4, 5]


def greedy(names, known):
    """Plain Python, one name after the other: (type, name) -> id or the name's own seq."""
    out, held = {}, {}
    for eid, kind, name in sorted(known):
        held.setdefault((kind, name[:3]), []).append((("known", eid), name))
    for kind, name, seq in sorted(names, key=lambda n: n[2]):
        if (kind, name) in out:
            continue
        same = [e for e, k, n in known if (k, n) == (kind, name)]
        leaders = held.setdefault((kind, name[:3]), [])
        hit = ("known", min(same)) if same else None
        if hit is None and len(name) >= 5:
            hit = next((who for who, other in leaders[:100] if difflib.SequenceMatcher(None, name, other).ratio() >= 0.9), None)
        if hit is None:
            hit = ("new", seq)
            leaders.append((hit, name))
        out[kind, name] = hit
    return out


@pytest.mark.parametrize("stretch", [3, 2_000])
def test_entity_ids_like_plain_python(spark, monkeypatch, stretch):
    import random

    monkeypatch.setattr(M, "STRETCH", stretch)
    rng = random.Random(3)
    base = ["united nations", "united nation", "abcde", "abcdf", "unity", "uni", "union of states"]
    made = [("ORG", rng.choice(base) + rng.choice(["", "s", " x", "al"]), i) for i in range(60)] + [("PER", "united nations", 900)]
    made += [("LOC", f"abc{i:03d}{'q' * (i % 7)}", 1000 + i) for i in range(130)]  # more leaders than count
    known = [(7, "ORG", "united nations"), (9, "ORG", "unitx"), (11, "LOC", "abc000")]
    mentions = spark.createDataFrame([(n.title(), k, n, s) for k, n, s in made] + [("x", None, "n", 5000), ("x", "ORG", "", 5001), ("x", "ORG", None, 5002)], "entity_name string, entity_type string, normalized_name string, seq long")
    entities = spark.createDataFrame(known, "entity_id long, entity_type string, normalized_name string")
    ids, added = M.get_or_insert(mentions, entities)
    got = {(r.entity_type, r.normalized_name): r.entity_id for r in ids.collect()}
    want = greedy(made, known)
    new = {r.normalized_name: r.entity_id for r in added.collect() if r.entity_type == "ORG"}
    assert {got.pop(("", "n")), got.pop(("ORG", ""))} == {-1} and set(got) == set(want)
    groups = {}
    for key, who in want.items():
        groups.setdefault(who, set()).add(got[key])
        if who[0] == "known":
            assert got[key] == who[1]
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
    fresh = sorted(r.entity_id for r in added.collect())
    assert fresh == list(range(12, 12 + len(fresh))) and new
    if stretch > 3:
        again, none = M.get_or_insert(mentions, entities.unionByName(added.select(entities.columns)))
        assert none.count() == 0
        leads = {(r.entity_type, r.normalized_name): r.entity_id for r in added.collect()}
        assert {k: v for k, v in ((((r.entity_type, r.normalized_name)), r.entity_id) for r in again.collect()) if k in leads} == leads


def test_long_names_are_cut(spark):
    mentions = spark.createDataFrame([("N" * 2000, "T" * 30, "n" * 600, 1)], "entity_name string, entity_type string, normalized_name string, seq long")
    none = spark.createDataFrame([], "entity_id long, entity_type string, normalized_name string")
    ids, added = M.get_or_insert(mentions, none)
    row = added.first()
    assert (len(row.entity_name), len(row.entity_type), len(row.normalized_name), row.entity_id, row.frequency) == (1024, 20, 512, 1, 0)


def guess(text):
    by = F.when(text.contains("bonjour"), "fr").when(text.contains("hallo"), "de").otherwise("en")
    return F.array(F.struct(by.alias("lang"), F.when(text.contains("perhaps"), 0.2).otherwise(0.9).alias("score")))


def test_enrichment(spark):
    articles = spark.createDataFrame([(1, "hello there, plain words"), (2, "bonjour à tous"), (3, "hallo"), (4, "perhaps so"), (5, None), (6, "Like plzz now"), (7, "done already"), (8, "   ")], "id long, body string")
    done = spark.createDataFrame([(7, "POSITIVE"), (1, None)], "article_id long, sentiment_label string")
    out = E.enrich(articles, done, guess)
    assert {r.id: r.lang for r in out.work.collect()} == {1: "en", 2: "fr"}
    assert {r.id for r in out.skipped.collect()} == {3, 4, 6, 8}  # emptied by cleaning, too
    assert out.work.where("id = 2").first().text_topic == "bonjour à tous"
    assert [r.id for r in E.of_language(out.work, "fr").collect()] == [2]
    for table, label in E.LABELS.items():
        old = tables.empty(spark, schemas.RELATIONS[table].schema())
        once = E.merged_rows(old, table, out.rows[table])
        got = {r.article_id: (r.language, r[label]) for r in once.collect()}
        assert got == {1: ("en", None), 2: ("fr", None), **{i: (None, "SKIPPED") for i in (3, 4, 6, 8)}}
        assert rows(E.merged_rows(once, table, out.rows[table])) == rows(once)
    nothing = E.enrich(articles.where("false"), done, guess)
    assert nothing.work.count() == nothing.skipped.count() == nothing.rows["article_topics"].count() == 0


def test_tracking_table():
    assert tables.tracking_table(False, False, False, True) == "qwen_article_sentiments"
    assert tables.tracking_table(True, False, False, True) == tables.tracking_table(False, False, False, False) == "article_sentiments"


def test_replace_table(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    assert tables.replace_table(spark.range(5).toDF("a"), path) == 5
    old = spark.read.parquet(path)
    assert tables.replace_table(old.where("a > 2"), path) == 2  # reads what it replaces
    assert tables.replace_table(old.where("false").select("a"), path, keep_if_empty=True) == 0
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception):
        tables.replace_table(spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("a")), path)
    assert spark.read.parquet(path).count() == 2
    assert tables.replace_table(spark.range(0).toDF("a"), path) == 0
    assert spark.read.schema("a long").parquet(path).count() == 0
    assert [p.name for p in tmp_path.iterdir() if ".old" in p.name] == []


def test_csv(spark, tmp_path):
    good = tmp_path / "a.csv"
    good.write_text('langue,texte\nfr,"un ""mot""\nencore"\n', "utf-8")
    assert tables.labelled_csv(spark, [f"{tmp_path}/none.csv", str(good)]).first().texte == 'un "mot"\nencore'
    with pytest.raises(FileNotFoundError):
        tables.labelled_csv(spark, [f"{tmp_path}/none.csv"])
    bad = tmp_path / "b.csv"
    bad.write_text("langue\nfr\n", "utf-8")
    with pytest.raises(ValueError):
        tables.labelled_csv(spark, str(bad))
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "id int, t string")
    assert tables.report_csv(df, f"{tmp_path}/r/out.csv") == 2
    assert (tmp_path / "r" / "out.csv").read_bytes().startswith(b"\xef\xbb\xbfid,t")
    assert tables.report_csv(df.where("false"), f"{tmp_path}/r/none.csv", if_rows=True) == 0 and not (tmp_path / "r" / "none.csv").exists()
    with pytest.raises(ValueError):
        tables.report_csv(df, f"{tmp_path}/r/x.csv", limit=1)


def test_lookup_and_relations(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    assert [r.id for r in tables.lookup(df, t=None).collect()] == [2] and tables.lookup(df, id=1, t="a").count() == 1
    none = tables.relation(spark, str(tmp_path), "article_topics")
    assert none.columns == ["article_id", "language", "topic_label", "topic_score"] and none.count() == 0
    spark.createDataFrame([("7", "x", 1)], "article_id string, topic_label string, more int").write.parquet(f"{tmp_path}/article_topics.parquet")
    assert tuple(tables.relation(spark, str(tmp_path), "article_topics").first()) == (7, None, "x", None)


def test_tables_of_earlier_versions(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS news LOCATION '{tmp_path}/news'")
    try:
        spark.sql("CREATE TABLE news.articles_enriched (article_id bigint, language string, sentiment_label string, gpu_time_ner int) USING parquet")
        spark.sql("INSERT INTO news.articles_enriched VALUES (1, 'en', 'POSITIVE', 5)")
        spark.sql("CREATE TABLE news.analytics_topic_peaks (year_month string) USING parquet")
        spark.sql("CREATE TABLE news.analytics_dominant_topics (x int) USING parquet")
        assert schemas.upgrade(spark, "news")
        assert tuple(spark.table("news.article_sentiments").first()) == (1, "en", "POSITIVE", None)
        for name, relation in schemas.RELATIONS.items():
            if name not in schemas.INPUTS:
                assert set(spark.table(f"news.{name}").columns) == {f.name for f in relation.schema().fields}, name
        assert not spark.catalog.tableExists("news.analytics_dominant_topics")
        assert schemas.upgrade(spark, "news") == []
        schemas.drop_results(spark, "news")
        assert not spark.catalog.listTables("news")
    finally:
        spark.sql("DROP DATABASE news CASCADE")


def test_incremental_runs_see_each_file_once(spark, tmp_path):
    folder, seen = f"{tmp_path}/in", []
    each = lambda df, n: seen.extend(r.a for r in df.collect())
    spark.range(3).toDF("a").coalesce(1).write.parquet(folder)
    assert run_available(spark, folder, "a long", f"{tmp_path}/cp", each) == 1
    spark.range(10, 12).toDF("a").coalesce(1).write.mode("append").parquet(folder)
    assert run_available(spark, folder, "a long", f"{tmp_path}/cp", each) == 1
    assert run_available(spark, folder, "a long", f"{tmp_path}/cp", each) == 0
    assert sorted(seen) == [0, 1, 2, 10, 11]
