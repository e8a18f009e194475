"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from attesta.plans.catalogue import QUERIES
from oracle.sql import ORACLE_SQL

from .compare import connect, differences

SF = "/root/testdata/sf0.001"

# Queries whose rows depend on a fitted index; tests/test_similar.py measures their recall.
WITHOUT_SQL = {"similar_claims"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) | WITHOUT_SQL
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
