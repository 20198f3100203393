"""The pipeline's near_dedup stage against all pairs, at similarity 0.8."""

import random

import corpus_pipeline
from presswork.llm import minhash
from test_minhash import shingles


def brute(rows, percent):
    """The least id of each group that links of ``percent`` or more make."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i) > 0:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d for d in sets if find(d) == d}


def test_stage_takes_eighty_percent(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(150):  # pairs from about 0.74 to 0.9
        base = [word() for _ in range(rng.randint(30, 300))]
        copy = list(base)
        for at in range(rng.randrange(5), len(copy), rng.randint(35, 90)):
            copy[at] = word()
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    df = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")
    want = brute(rows, 80)
    assert len(brute(rows, 85)) - len(want) >= 20
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == want


def test_miss_rate():
    assert (minhash.common(85), minhash.common(80)) == (16 / 32, 13 / 32)
