"""Every core query that SQL can express gives what DuckDB gives."""

import pytest

from compare import connect, same
from ligature.plans import linkage, sourcing, star, training

QUERIES = {n: (f, m.oracle_sql()[n]) for m in (linkage, sourcing, star, training) for n, f in m.queries().items() if n in m.oracle_sql()}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, con, name):
    f, sql = QUERIES[name]
    same(f(spark, sf), con, sql)
