"""Every registered query against its DuckDB SQL on the smallest data."""

import os

import __spark_entry__ as entry
import oracle_check
import pytest

from brevia.plans.oracle import ORACLE
from brevia.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SF_DIR)


def test_every_query_of_the_library_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    row = entry.entry(spark).first()
    assert set(row.asDict()) == {"doc_id", "kept", "unknown", "unknown_share"}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    found = entry.queries()[name](spark, SF_DIR)
    assert oracle_check.compare(found, con, entry.oracle_sql()[name]) is None
