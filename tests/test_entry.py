"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    values = df.itertuples(index=False, name=None)
    return sorted(repr(tuple(v.item() if hasattr(v, "item") else v for v in r)) for r in values)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    got = E.queries()[name](spark, SF).toPandas()
    want = sql.sql(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_without_sql_runs(spark):
    for name in set(E.queries()) - set(E.oracle_sql()):
        assert E.queries()[name](spark, SF).count() > 0


def test_bloom_candidates_cover_the_exact_ones(spark):
    exact = E.S.candidate_bins(E._peptides(spark, SF, fine=True), "LY[AEG]N")
    assert exact.subtract(E.queries()["bloom_candidates"](spark, SF)).count() == 0


def test_entry(spark):
    assert E.entry(spark).count() > 0
