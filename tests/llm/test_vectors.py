"""Vector searches against brute force."""

import numpy as np
from pyspark.sql import functions as F

from presswork.llm import exact_topk, mih
from presswork.llm.queries import op1_mih, op3_exact_topk

SCHEMA = "vec_id long, embedding array<float>, id string, v int, dim int"


def load(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)


def test_mih_recall_and_scores(spark, medium):
    ids, x = load(spark, medium)
    got = {}
    for r in op1_mih(spark, medium).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [j for j in np.lexsort((ids, d)) if j != q][:10]
        mine = sorted(got[ids[q]])
        assert [m[0] for m in mine] == list(range(1, 11))
        hits += len({m[1] for m in mine} & {ids[j] for j in best})
        total += 10
        for _, j, s in mine:
            assert abs(s - d[np.flatnonzero(ids == j)[0]]) < 1e-9
    assert hits / total >= 0.95


def test_mih_recall_on_the_larger_table(spark):
    """Every query of sf0.1: recall, and that every block was indexed whole."""
    sf = "/root/testdata/sf0.1"
    ids, x = load(spark, sf)
    got = {}
    for r in op1_mih(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert len(got) == (ids % 100 == 0).sum() and hits >= 0.95 * 10 * len(got)


def grouped(rng, groups, size, dim, spread):
    return np.concatenate([rng.standard_normal((size, dim)) * spread + rng.standard_normal(dim) for _ in range(groups)])


def test_mih_sees_few_rows_on_grouped_vectors():
    """Recall, and the share of rows that probing retrieves: wide substrings on a large block, narrow ones on a small."""
    rng = np.random.default_rng(3)
    for groups, size, most in ((500, 40, 0.1), (60, 40, 0.1), (30, 40, 0.5)):
        x = grouped(rng, groups, size, 32, 0.05)
        ids = np.arange(len(x))
        run, index = mih.prepared(mih.Codes(x[rng.permutation(len(x))[: mih.SAMPLE]]), 10, ids, x)
        assert index.part == (16 if len(x) >= mih.WIDE_FROM else 8)
        hits, asked = 0, ids[::200]
        for q, found, _ in run(asked, x[asked]):
            d = ((x - x[q]) ** 2).sum(1)
            d[q] = np.inf
            hits += len(set(found.tolist()) & set(np.argsort(d)[:10].tolist()))
        assert hits >= 0.95 * 10 * len(asked)
        assert index.looked_at / (len(x) * len(asked)) <= most


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 256, (3000, 16), dtype=np.uint8)
    codes[1:400] = codes[0] ^ np.packbits(rng.random((399, 128)) < 0.06, axis=1)
    index = mih.Index(codes)
    code, seen = index.cut(codes[:1])[0], np.zeros(len(codes), bool)
    apart = np.bitwise_count(codes ^ codes[0]).sum(1)
    for flips in range(3):
        index.probe(code, flips, seen)
        assert seen[apart <= index.parts * (flips + 1) - 1].all()


def brute(ids, x, every, k):
    v = np.floor(64 * x).astype(np.int64)
    out = set()
    for q in np.flatnonzero(ids % every == 0):
        s = v @ v[q]
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out |= {(int(ids[q]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(best)}
    return out


def test_exact_topk(spark, medium):
    ids, x = load(spark, medium)
    assert {tuple(r) for r in op3_exact_topk(spark, medium).collect()} == brute(ids, x, 20, 20)


def test_exact_topk_prunes_right():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 48)) * np.exp(-np.arange(48) / 6)
    ids, kept = np.arange(3000), []
    v = np.floor(64 * x)
    run = exact_topk.prepared(20, ids, v, kept)
    got = {(int(q), i + 1, int(j), int(s)) for q, n, t in run(ids[::20], v[::20]) for i, (j, s) in enumerate(zip(n, t, strict=True))}
    assert got == brute(ids, x, 20, 20)
    assert np.mean(kept) < 0.6  # of the products that a scan without bounds makes


def edge_rows(spark):
    a = [1.0, 0.0, 2.0, 0.0]
    rows = [(0, a), (100, a), (7, a), (7, a), (5, [0.0] * 4), (6, None), (8, [1.0, None, 0.0, 0.0]), (9, [float("nan")] * 4), (10, [float("inf"), 0.0, 0.0, 0.0]), (None, a), (200, [3.0]), (11, []), (12, [3.0, 0.0, 1.0, 1.0])]
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)


def test_edges(spark):
    df = edge_rows(spark)
    got = [tuple(r) for r in mih.nearest(df, exact_topk.is_multiple(100), 3).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 7), (0, 2, 7), (0, 3, 100), (100, 1, 0), (100, 2, 7), (100, 3, 7)]
    top = [tuple(r) for r in exact_topk.largest_products(df, exact_topk.is_multiple(100), 5).where("query_id = 0").orderBy("rank").collect()]
    assert top == [(0, 1, 7, 20480), (0, 2, 7, 20480), (0, 3, 12, 20480), (0, 4, 100, 20480), (0, 5, 5, 0)]
    none = df.where(F.lit(False))
    assert mih.nearest(none, exact_topk.is_multiple(100)).count() == 0
    assert exact_topk.largest_products(none, exact_topk.is_multiple(20)).count() == 0


def test_huge_components(spark):
    df = spark.createDataFrame([(20, [3e30, 1.0]), (1, [3e30, 0.0]), (2, [-3e30, 5.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in exact_topk.largest_products(df, exact_topk.is_multiple(20)).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 64 * 128), (2, -(2**63))]
