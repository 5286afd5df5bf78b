"""The queries with results stated by hand, against their SQL on the smallest tables."""

import glob
import os

import pytest

from fieldmill.plans import catalogue, moderation, stated  # noqa: F401  they add their queries to the catalogue

D = "/root/testdata/sf0.001"
OWN = [n for n, f in catalogue.QUERIES.items() if f.__module__ in ("fieldmill.plans.moderation", "fieldmill.plans.stated") and n in catalogue.SQL]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query_gives_what_its_sql_gives(spark, duck, name):
    want = duck.sql(catalogue.SQL[name])
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = catalogue.QUERIES[name](spark, D)
    assert sorted(got.columns) == columns
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    assert rows and rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_every_hold_code_has_a_case():
    codes = {c for _, stated_ in moderation.CASES for c in stated_.split(",") if c}
    assert len(codes) == 34 + 2  # and two flags of the city's evidence
