"""Every query of the catalogue against its SQL, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import check_queries  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from bagwise.catalogue.oracles import oracles  # noqa: E402
from bagwise.catalogue.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(small):
    return check_queries.connect(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, con, name):
    assert not check_queries.compare(spark, con, small, name).startswith("FAIL")


def test_entry(spark):
    assert entry.entry(spark).count() == 15


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracles())
    assert set(QUERIES) <= set(entry.queries()) and set(oracles()) <= set(entry.oracle_sql())
