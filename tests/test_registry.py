"""Every registered query beside its SQL, on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
import check
from tickerloom.testbed.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    return check.duck(FOLDER)


def test_queries_without_sql_are_known():
    # A fitted model: tests/test_learned.py holds it against a plain fit and held-out labels.
    assert set(QUERIES) - set(ORACLES) == {"u4_learned_scorer"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    result = check.compare(QUERIES[name](spark, FOLDER), duck.sql(ORACLES[name]))
    assert result.startswith("ok"), result


def test_all_are_in_the_entry():
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
