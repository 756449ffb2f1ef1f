import oracle
import pytest

import __spark_entry__
from evidra import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    ok, said = oracle.same(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])
    assert ok, said


def test_contract(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
