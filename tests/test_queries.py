"""Every registered query against its SQL in DuckDB, and the rest for a stable schema, on the smallest tables."""

import os

import pytest

import __spark_entry__
from topicweave import catalog

SF = "/root/testdata/sf0.001"
SLOW = {"lda_topics", "nmf_topics", "density_fit", "anchor_fit", "keyphrase_fit"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows_of(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), duck.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - SLOW))
def test_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_the_library_does_not_use_the_subpackage():
    root = os.path.dirname(catalog.__file__)
    for d, _, files in os.walk(root):
        if os.path.basename(d) in ("llm", "__pycache__"):
            continue
        for f in files:
            if f.endswith(".py"):
                assert "topicweave.llm" not in open(os.path.join(d, f), encoding="utf-8").read()
