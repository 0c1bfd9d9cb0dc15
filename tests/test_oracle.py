"""Every query of the log operators against its SQL in DuckDB."""

import os

import duckdb
import pytest

from logweave.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = core.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[x]) for x in columns) for r in df.collect())
    if name in core.SQL:
        cursor = db.execute(core.SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(str(r[names.index(x)]) for x in columns) for r in cursor.fetchall())
    else:
        assert got
