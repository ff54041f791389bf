"""Each registered query of the engine's own operators against its SQL, on the smallest tables."""

import pytest
from oracle import database, difference, duck_bag, spark_bag

from kestrane import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return database(SF)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    got = spark_bag(catalogue.queries()[name](spark, SF))
    if sql := catalogue.oracle_sql().get(name):
        assert difference(got, duck_bag(duck, sql)) == ""
    else:
        assert got[1]
