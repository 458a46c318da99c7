"""Every registered query beside its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connect, difference
from conftest import SMALL

import __spark_entry__ as entry
from rowassay import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns[:2] == ["suite_id", "rule_index"] and out.count() == 26


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    problem = difference(QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLE[name]).df())
    assert problem is None, problem
