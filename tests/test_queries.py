"""Every query of the engine against its equivalent in another SQL engine."""

import math

import duckdb
import pytest

from keystrata import operators

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


@pytest.mark.parametrize("name", sorted(operators.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = operators.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in operators.ORACLES:
        assert got
        return
    found = duck.execute(operators.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_approximate_counts_are_near(spark, sf_dir):
    exact = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey").distinct().count()
    row = operators.QUERIES["approx_count_distinct"](spark, sf_dir).first()
    assert abs(row.a - exact) <= 0.15 * exact and abs(row.b - exact) <= 0.08 * exact


def test_errors_of_analysis(spark, sf_dir):
    from pyspark.errors import AnalysisException

    from keystrata.operators.relational import run

    for text in ("SELECT n_name, count(*) FROM {nation} GROUP BY n_regionkey", "SELECT array(1) AS a UNION ALL SELECT 1"):
        with pytest.raises(AnalysisException):
            run(spark, sf_dir, text)
