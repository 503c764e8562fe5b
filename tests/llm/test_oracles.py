"""The operators' queries against their equivalents in another SQL engine."""

import duckdb
import pytest

from keystrata.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    assert got == want and got
