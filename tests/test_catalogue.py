"""Every query of the catalogue against an independent engine, on the smallest tables."""

import duckdb
import pytest

from lakequill import catalogue
from lakequill.sources.folders import TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted([tuple("null" if r[i] is None else repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in found])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, oracle, name):
    df = QUERIES[name](spark, FOLDER)
    got = plain(df.columns, df.collect())
    cursor = oracle.execute(ORACLES[name])
    assert got == plain([d[0] for d in cursor.description], cursor.fetchall())
