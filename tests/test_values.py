"""Functions of single values on captured shapes with results worked by hand; queries of columns have rows of more than one value."""

import pytest

from oracle import same
from terrano.plans import column_queries, registry, value_queries


@pytest.mark.parametrize("name", sorted(set(value_queries.CASES) & set(column_queries.CASES)))
def test_shapes(spark, sf, name):
    """Those whose registered query reads columns; the others are compared with the registered queries."""
    same(spark, value_queries.QUERIES[name], value_queries.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(column_queries.CASES))
def test_columns_tell_values_apart(spark, sf, name):
    assert registry.QUERIES[name] is column_queries.QUERIES[name]
    assert registry.QUERIES[name](spark, sf).select("result").distinct().limit(2).count() == 2
