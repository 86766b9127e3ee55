"""The registered corpus queries against their SQL, run by DuckDB on the same tables."""

import os

import duckdb
import pytest

from pathloom.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rows(columns, found):
    names = sorted(columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(r[columns.index(n)]) for n in names) for r in found), key=str)


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    found = c.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())
