import pytest

import __spark_entry__ as entry
import compare
from pagelens.plans.catalog import REGISTRY
from pagelens.plans.reference_sql import REFERENCE_SQL

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    with compare.connect(SF) as connection:
        yield connection


def test_every_query_has_reference_sql():
    assert set(REGISTRY) == set(REFERENCE_SQL)
    assert set(REGISTRY) <= set(entry.queries()) and set(REFERENCE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_reference_sql(spark, con, name):
    assert compare.compare(spark, con, name, SF) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
