"""Each stage of the pipeline against its operator's rule, on its own input."""

import corpus_pipeline
from presswork.llm import minhash, pii
from presswork.llm.common import written


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, small), name)
        if name != "packing":
            assert docs.columns == columns
        if name == "near_dedup":
            kept = {r.doc_id for r in minhash.near_duplicates(before, percent=corpus_pipeline.SIMILAR).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept and docs.count() == len(kept)
        if name == "pii":
            assert docs.count() == before.count()
            left = pii.find_pii(docs).agg({"n_email": "sum", "n_card": "sum", "n_phone": "sum", "n_ip": "sum"}).first()
            assert set(left) == {0}
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "packing"]


EDGES = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "  \n", None, None, 3), (None, "a text that has no id, only words in it", "en", "a", 40),
    (4, "the same words in two rows of one id here", "en", "a", 41), (4, "the same words in two rows of one id here", "en", "a", 41), (4, "other words under the id that is used twice", "en", "b", 44),
    (5, "the same words in two rows of one id here", "de", "c", 41), (6, "mail a@b.c or call +1 234 567 8901 now, thanks to all", "en", "a", 52), (7, "plain words " * 3000, "en", "a", 36000),
]


def test_stages_on_edge_cases(spark, small):
    """Nulls in every column, empty and long texts, repeated ids and rows, columns named like the operators' helpers."""
    clash = ["row", "body", "spans", "base", "place", "keeper", "set_id", "n", "score", "x", "quality"]
    docs = spark.createDataFrame([(*r, *["a@b.c"] * len(clash)) for r in EDGES], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, small)
    assert good.columns == docs.columns and good.count() <= len(EDGES)
    unique = written(stages["near_dedup"](spark, docs, small), "edges")
    assert unique.columns == docs.columns
    texts = sorted((r.text or "", str(r.doc_id)) for r in unique.collect())
    want = [(t or "", str(d)) for d, t, *_ in EDGES if d != 5]
    want.remove((EDGES[4][1], "4"))
    assert texts == sorted(want)
    clean = stages["pii"](spark, unique, small)
    assert clean.columns == docs.columns
    got = {str(r.doc_id): r for r in clean.collect()}
    assert got["6"].text == "mail [EMAIL] or call [PHONE] now, thanks to all" and got["6"].n_chars == len(got["6"].text) and got["6"].row == "a@b.c"
    assert got["1"].text is None and got["1"].n_chars is None and got["2"].n_chars == 0
    pieces = stages["packing"](spark, clean, small).collect()
    assert sorted(str(r.doc_id) for r in pieces if r.start == 0) == sorted(str(r.doc_id) for r in unique.collect())


def test_stages_on_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
