import pytest

from rasterloom.plans import registry
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_against_sql(spark, sf_dir, name):
    assert compare(registry.QUERIES[name](spark, sf_dir), registry.SQL[name], sf_dir) > 0
