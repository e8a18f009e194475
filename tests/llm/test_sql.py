"""Registered text queries against their SQL, and the guard around the subpackage."""

import pytest

import __spark_entry__ as entry
from attesta.llm.queries import ORACLE_SQL, QUERIES

from ..compare import connect, differences

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name]) == []
