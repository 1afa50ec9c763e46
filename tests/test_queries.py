"""Every registered query against its check SQL, with a look at its plan."""

from __future__ import annotations

import os

import pytest
from check_queries import compare, connect

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_matches_sql(spark, con, name):
    wrong, _, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert wrong is None


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_is_lazy_and_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["USER_ID", "ITEM_ID", "score", "rank"]
    assert not df.isEmpty()
