"""Every registered query against its SQL."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as E
import oracle
from check_oracle import connect, difference
from tenderlake.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")


@pytest.fixture(scope="module")
def database():
    return connect(SF)


def test_each_query_has_sql():
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, database, name):
    got = E.queries()[name](spark, SF).toPandas()
    assert difference(got, database.execute(E.oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert "hhi" in E.entry(spark).columns
