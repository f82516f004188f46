"""Every listing query that has SQL equals it; the others have rows."""

import pytest

from oracle import same
from terrano.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, sf, name):
    assert same(spark, registry.QUERIES[name], registry.SQL[name], sf) > 0  # no rows on both sides would prove nothing


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_has_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
