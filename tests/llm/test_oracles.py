import pytest

from eventloom.llm import registry
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    check(registry.QUERIES[name], registry.ORACLE_SQL[name], spark, sf)
