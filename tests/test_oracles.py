"""Every query of the data plane against its SQL twin, and those without one for rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from loomlake.plans import catalog
from tests.oracle import compare, connect

#: Queries that may have no rows on the smallest tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.TWINS))
def test_twin(spark, con, sf_dir, name):
    said = compare(spark, con, entry, name, sf_dir)
    assert said == "" or (said == "no rows" and name in MAY_BE_EMPTY)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.TWINS)))
def test_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
