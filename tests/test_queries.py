"""The registered queries against their SQL, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect, duck_rows, spark_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# these fit models on classes the smallest tables do not all have; `oracle_check` runs them at sf0.01
LARGER = {"lopo_study", "nested_evaluation", "pooled_out_of_fold"}


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - LARGER))
def test_query_equals_its_sql(spark, tables, name):
    found = spark_rows(entry.queries()[name](spark, SF))
    assert compare(found, duck_rows(tables, entry.oracle_sql()[name])) is None
