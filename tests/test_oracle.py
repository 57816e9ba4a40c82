"""Every registered query against its DuckDB oracle at sf0.001 (rows-only
for queries without SQL), with the same order-insensitive comparison the
driver uses."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import digest, type_mismatches
from tessera.sources.tables import TABLES

SF = os.environ.get("TESSERA_TEST_SF", "/root/testdata/sf0.001")
QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_is_registered_once():
    assert len(QUERIES) >= 90
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert len(cols) == len(set(cols))
        return
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert type_mismatches(df.dtypes, con, ORACLE[name]) == []
    assert len(rows) == len(drows)
    assert digest(cols, rows)[0] == digest(dcols, drows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "hybrid_score" in df.columns
