"""Every query with SQL gives the rows DuckDB gives, on the smallest tables."""

import pytest
from oracle_check import compare, connect

from plumbline.plans.catalog import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"

# Model fits have no SQL; these two stand for them here.
FITTED = ["F05_feature_pipeline", "F11_batch_scoring"]


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    outcome = compare(spark, db, name, QUERIES[name], SQL[name], SMALL)
    assert outcome.startswith("ok"), outcome


@pytest.mark.parametrize("name", FITTED)
def test_has_rows(spark, db, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as contract

    df = contract.entry(spark)
    assert df.count() > 0 and "f1_gap" in df.columns
