"""Every registered query beside its SQL on the smallest data set."""

import pytest

from lumenframe.plans import catalog
from tests.check_sql import compare, duck

SF = "/root/testdata/sf0.001"
# Same code as a faster twin, or measured on its own below: model searches are slow to repeat.
SLOW = {"d02_model_space", "d04_search"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in SLOW])
def test_query_matches_sql(spark, con, name):
    same, message = compare(spark, con, SF, name, catalog.queries()[name], catalog.oracle_sql().get(name))
    assert same, message


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
