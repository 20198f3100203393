"""Every registered query of the news engine against its DuckDB twin at sf0.01."""

import math

import duckdb
import pytest

from presswork.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(medium):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{medium}/{t}.parquet'")
    return con


def key(row):
    return tuple("~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_like_duckdb(spark, duck, medium, name):
    df = catalogue.queries()[name](spark, medium)
    names = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(names).collect()), key=key)
    want = duck.execute(f"SELECT {', '.join(names)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) and y is not None else str(x) == str(y) for x, y in zip(a, b, strict=True)), (a, b)


def test_known_counts(spark, medium):
    count = lambda n: catalogue.queries()[n](spark, medium).count()
    assert (count("topics_by_month"), count("calendar_densify")) == (397, 400)
    assert (count("topic_peaks_default"), count("topic_peaks_w6_z15"), count("topic_peaks_w12_z20")) == (0, 18, 5)


def test_rows_only(spark, small):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        assert catalogue.queries()[name](spark, small).count() > 0
