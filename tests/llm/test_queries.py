import os

import pytest

from foliospark.llm import registry
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_query_against_sql(spark, name):
    oracle.same(spark, oracle.tables(), registry.queries()[name], registry.sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.sql())))
def test_other_queries_run(spark, name):
    assert registry.queries()[name](spark, oracle.DATA).count() > 0
