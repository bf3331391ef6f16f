import pytest

from siftmark.llm import registry

from ..test_oracle import same


@pytest.mark.parametrize("name", sorted(registry.collect("SQL")))
def test_query(spark, name):
    same(spark, registry.collect("QUERIES")[name], registry.collect("SQL")[name])
