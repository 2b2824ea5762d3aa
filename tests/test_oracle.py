"""Every query with an oracle agrees with DuckDB on the sf0.001 tables; the others run."""

import os
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from oracle_check import TABLES, kind, rows_of  # noqa: E402

from reelsift.queries import oracle_sql, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()
SLOW = {"rec_als_runs"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(n for n in queries() if n not in SLOW))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert df.columns
        return
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    stypes = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    dtypes = {c: kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    assert stypes == dtypes
    drows = rel.fetchall()
    assert Counter(rows_of(df.columns, srows)) == Counter(rows_of(rel.columns, drows))
