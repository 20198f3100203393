"""Quality on held-out labels; forward-backward against all paths; licence scans against Python and DuckDB."""

import itertools
import zlib

import duckdb
import numpy as np

from presswork.llm import licenses, quality
from presswork.llm.queries import op4_license, op10_quality


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op10_quality(spark, sf).collect()
    assert len(rows) == 10_000
    hits = {0: [], 1: []}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.held_out and r.doc_id in labels:
            hits[labels[r.doc_id]].append(r.predicted == labels[r.doc_id])
    assert np.mean(hits[1]) > 0.99 and np.mean(hits[0]) > 0.9


def test_marginals_are_sums_over_paths():
    rng = np.random.default_rng(1)
    model = quality.Chain()
    model.emit, model.step = rng.standard_normal(quality.N) * 0.3, rng.standard_normal((2, 2))
    count = np.array([3, 1, 4])
    x = rng.standard_normal((8, quality.N))
    first = np.cumsum(count) - count
    p, joint = model.marginals(x, first, count)
    want, pairs = np.zeros(8), np.zeros((2, 2))
    for f, n in zip(first, count, strict=True):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        w = np.array([np.exp(sum(x[f + t] @ model.emit for t in range(n) if s[t]) + sum(model.step[a, b] for a, b in zip(s, s[1:], strict=False))) for s in paths])
        w /= w.sum()
        for s, v in zip(paths, w, strict=True):
            want[f : f + n] += v * np.array(s)
            for a, b in zip(s, s[1:], strict=False):
                pairs[a, b] += v
    assert np.allclose(p, want) and np.allclose(joint, pairs)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "x\n\ny", 3.0), (3, "a b\n" * 50_000, 4.0), (3, "a b\n" * 50_000, 4.0), (4, "\n", 5.0), (5, "é😀" * 10, 0.1)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs, none)
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 0), (5, 0, 1), (4, None, 0), (None, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.where("false"), model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns


def scan(text):
    """The best template of each unit, in plain Python."""
    import re

    low, high = 0.8 / 1.2, 1.2 / 0.8
    paragraphs = re.split("\n[ \t\r]*\n", text)
    units = [("line", i, t) for i, t in enumerate(text.split("\n"))]
    units += [("paragraph", i, t) for i, t in enumerate(paragraphs) if "\n" in t]
    units += [("text", 0, text)] if len(paragraphs) > 1 else []
    for unit, place, t in units:
        g = set(licenses.bigrams_of(t))
        best = None
        for name, texts in licenses.TEMPLATES.items():
            for b in map(set, map(licenses.bigrams_of, texts)):
                n = len(g & b)
                if g and len(b) * low <= len(g) <= len(b) * high and 2 * n >= 0.8 * (len(g) + len(b)):
                    best = min(filter(None, [best, (-2 * n / (len(g) + len(b)), name, -n, len(g))]))
        if best:
            yield unit, place, best[1], -best[2], best[3], -best[0]


def test_licenses(spark):
    apache = licenses.TEMPLATES["Apache-2.0"][1]
    wrapped = "\n".join(apache[i : i + 70] for i in range(0, len(apache), 70))
    texts = {1: "Text.\nLicensed under the Apache License, Version 2.0.", 2: None, 3: "", 4: "\n\n" + wrapped + "\n\nother words", 5: "this work is licensed under the gnu general public license version 3 only", 6: "Licensed", 7: "x " * 100_000, 8: "RELEASED  under: the MIT license", 9: apache}
    df = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, size int")
    got = sorted(tuple(r) for r in licenses.scan(df).collect())
    assert got == sorted((k, *u) for k, t in texts.items() for u in scan(t or ""))
    assert {g[0] for g in got} == {1, 4, 5, 8, 9}
    assert licenses.scan(df.where("false")).count() == 0


def test_op4_like_duckdb(spark, medium):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{medium}/documents.parquet'")
    want = sorted(con.execute(licenses.duckdb_sql()).fetchall())
    assert want and sorted(tuple(r) for r in op4_license(spark, medium).collect()) == want


def test_whole_licences_are_found(spark):
    """A file that is a licence, wrapped, with a copyright line and paragraphs; and notices that differ in one word."""
    import textwrap

    whole = {name: texts[-1] for name, texts in licenses.TEMPLATES.items() if len(licenses.bigrams_of(texts[-1])) > 60}
    assert {"MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense"} <= set(whole)
    files = {name: "Copyright (c) 2020 Some Body\n\n" + textwrap.fill(text, 72) for name, text in whole.items()}
    files |= {"LGPL-3.0": licenses.TEMPLATES["LGPL-3.0"][0], "AGPL-3.0": licenses.TEMPLATES["AGPL-3.0"][0], "GPL-3.0": licenses.TEMPLATES["GPL-3.0"][1]}
    names = list(files)
    df = spark.createDataFrame([(i, files[n]) for i, n in enumerate(names)], "doc_id long, text string")
    got = {}
    for r in licenses.scan(df).collect():
        if r.unit in ("text", "paragraph") or "\n" not in files[names[r.doc_id]]:
            got.setdefault(names[r.doc_id], set()).add(r.license)
    assert got == {n: {n} for n in names}


def test_texts_without_telling_words_cannot_match(spark):
    """The words that let a text through: few of them, none missing; texts with just enough of a template are still found."""
    import random
    import re

    sets = [licenses.bigrams_of(t) for texts in licenses.TEMPLATES.values() for t in texts]
    for threshold in (0.5, 0.8, 0.95):
        telling = set(licenses.telling_words(sets, threshold))
        assert 0 < len(telling) < 200
        for b in sets:
            assert sum(not telling & set(x.split()) for x in b) < threshold / (2 - threshold) * len(b)
    assert licenses.telling_words(sets, 0.0) == []
    assert not {"the", "and", "or", "of"} & set(licenses.telling_words(sets, 0.8))
    rng = random.Random(7)
    texts = []
    for t in (t for texts in licenses.TEMPLATES.values() for t in texts):
        words = re.findall("[A-Za-z0-9]+", t)
        for share in (0.05, 0.1, 0.15, 0.2):
            kept = [w for w in words if rng.random() > share]
            texts.append(rng.choice([" ", "_", "\n", "\u212a"]).join(kept).upper() + rng.choice(["", "\n\nof the and\nor", "\u0130"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in licenses.scan(df).collect())
    assert len(got) > 50 and got == sorted((k, *u) for k, t in enumerate(texts) for u in scan(t))
