"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check
from crawlspark.plans.oracles import ORACLES
from crawlspark.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return check.tables(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.queries()) >= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, folder, name):
    problem = check.compare(spark, con, folder, name)
    assert problem in ("", "no rows")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
