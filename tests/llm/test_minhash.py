"""Near duplicates against all pairs."""

import random
import re
from itertools import combinations

import numpy as np

from presswork.llm import components as components_of
from presswork.llm import minhash
from presswork.llm.queries import op7_minhash


def shingles(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """rows: (doc_id, text) with ids that differ."""
    sets = {d: shingles(t) for d, t in rows}
    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in {p for ds in by.values() for p in combinations(sorted(ds), 2)}:
        i = len(sets[a] & sets[b])
        if 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {(d, len(s), find(d), find(d) == d) for d, s in sets.items()}


def test_op7(spark, medium):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{medium}/documents.parquet").collect()]
    assert {tuple(r) for r in op7_minhash(spark, medium).collect()} == brute(rows)


def test_groups_chains_and_common_passages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(45))
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    for _ in range(120):  # one passage in otherwise different texts
        add(passage + " " + " ".join(word() for _ in range(rng.randint(5, 80))))
    base = [word() for _ in range(150)]
    for _ in range(100):  # one group of near copies with more and fewer changes
        text = list(base)
        for _ in range(rng.randint(0, 8)):
            text[rng.randrange(150)] = word()
        add(" ".join(text))
    chain = [word() for _ in range(200)]
    for i in range(40):  # each like the next, the ends unlike
        chain[5 * i % 200] = word()
        add(" ".join(chain))
    for _ in range(30):
        add("  Same\ttext HERE\n")
    for text in ("", None, " \n", "one", "ONE", "one two three four", "one two three four five", "É one two three four five", "é one two three four five"):
        add(text)
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, 1, b"z") for d, t in rows], "doc_id long, text string, n int, set_id binary")
    assert {tuple(r) for r in minhash.near_duplicates(df).collect()} == brute(rows)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None), (6, "x"), (6, "y")], "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 0, None, True), (6, 1, 6, True), (6, 1, 6, True)], key=str)
    assert minhash.near_duplicates(df.where("false")).count() == 0
    assert minhash.keep_one(df.where("false")).count() == 0


def test_keep_one_judges_rows_by_their_text(spark):
    """Repeated ids with other texts stay; columns keep their order, names of helpers are free for callers."""
    copied = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        ("s", copied, 1), ("s", copied, 2), ("t", "other words stand here now", 2), ("t", "words of another kind", 3),
        ("s", "words of another kind", 3), ("b", copied, 1), ("a", copied, 1), ("n", None, 4), ("n", None, 4), ("n", "", 4),
        ("z", "nobody names this text at all", None), ("y", "nobody names this text at all", None), ("w", copied + " nobody", None),
    ]
    df = spark.createDataFrame(rows, "place string, text string, doc_id long").selectExpr("*", "place as row", "doc_id as n", "text as keeper", "map('k', 1) as listed")
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r.place, r.text, r.doc_id) for r in kept.collect()), key=str)
    want = [("a", copied, 1), ("t", "other words stand here now", 2), ("s", "words of another kind", 3), ("n", None, 4), ("n", None, 4), ("n", "", 4), ("y", "nobody names this text at all", None)]
    assert got == sorted(want, key=str)


def test_texts_without_ids_are_linked(spark):
    base = [f"w{i}" for i in range(80)]
    rows = [(None, " ".join([*base[:-1], f"end{k}"])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert minhash.keep_one(df).count() == 1


def test_estimate_and_forest_like_the_join():
    """The estimate of two sketches equals the union's sketch taken by hand; the forest joins what exact links join."""
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 2**62, 300))
    sets = []
    for k in range(120):
        own = base.copy()
        own[rng.choice(len(own), rng.integers(0, 40), replace=False)] = rng.integers(0, 2**62, 1)
        sets.append(np.unique(own) if k % 3 else np.unique(rng.integers(0, 2**62, rng.integers(1, 50))))
    pad = np.full((len(sets), minhash.SKETCH), minhash._NO_VALUE)
    for row, s in zip(pad, sets, strict=True):
        row[: min(len(s), minhash.SKETCH)] = s[: minhash.SKETCH]
    for a in range(0, len(sets), 7):
        got = minhash.estimates(pad[a], pad)
        for b, s in enumerate(sets):
            union = np.unique(np.concatenate([sets[a][: minhash.SKETCH], s[: minhash.SKETCH]]))[: minhash.SKETCH]
            assert abs(got[b] - np.isin(union, np.intersect1d(sets[a][: minhash.SKETCH], s[: minhash.SKETCH])).mean()) < 1e-12
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        i = len(np.intersect1d(sets[a], sets[b]))
        if 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
            root[find(b)] = find(a)
    edges = minhash.forest([bytes([k]) for k in range(len(sets))], sets, 85)
    mine = list(range(len(sets)))

    def top(x):
        while mine[x] != x:
            x = mine[x]
        return x

    for a, b in edges:
        assert top(a[0]) != top(b[0])  # a forest has no cycles
        mine[top(b[0])] = top(a[0])
    assert len({(find(k), top(k)) for k in range(len(sets))}) == len({find(k) for k in range(len(sets))}) == len({top(k) for k in range(len(sets))})


def test_misses_at_the_threshold_are_as_rare_as_stated():
    """Share of pairs right at the threshold whose sketches fall below the margin, over random pairs."""
    rng, n = np.random.default_rng(2), 400_000
    k, least = minhash.SKETCH, minhash.common(85)
    # of the union's 32 least values each is in both sets with chance 0.85
    low = (rng.random((n, k)) < 0.85).sum(1) < least * k
    assert low.sum() <= 3  # 1e-6 is stated, 6e-7 counted


def test_hubs_and_paths(spark, monkeypatch):
    monkeypatch.setattr(components_of, "HUB_LEAST", 20)
    monkeypatch.setattr(components_of, "HUB_SHARE", 1_000)
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000), (None, 5), (1, 2), (1, 2)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {tuple(r) for r in components_of.components(df).collect()}
    assert got == {(i, 0) for i in range(1, 300)} | {(1001 + i, 1000) for i in range(60)}
    assert components_of.components(df.where("false")).count() == 0
