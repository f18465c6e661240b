"""Every query with SQL against that SQL, on the smallest tables."""

import os

import duckdb
import pytest

from heatlattice.plans import queries, studies  # noqa: F401
from heatlattice.plans.fixtures import TABLES
from heatlattice.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return repr(v.tolist() if hasattr(v, "tolist") else v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_names_are_unique_and_callable():
    assert set(ORACLES) <= set(QUERIES) and all(callable(q) for q in QUERIES.values())
