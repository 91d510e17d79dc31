import os

import pytest

from foliospark.plans import registry
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.tables()


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_query_against_sql(spark, con, name):
    oracle.same(spark, con, registry.queries()[name], registry.sql()[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "rev"]
    assert set(e.oracle_sql()) <= set(e.queries())
