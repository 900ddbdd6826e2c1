"""Every core query on empty tables and on tables full of nulls."""

import pytest

from compare import connect, same
from damage import copies
from ligature.plans import linkage, sourcing, star, training

QUERIES = {n: (f, m.oracle_sql().get(n)) for m in (linkage, sourcing, star, training) for n, f in m.queries().items()}


@pytest.fixture(scope="module")
def damaged(spark, sf, tmp_path_factory):
    return copies(spark, sf, tmp_path_factory.mktemp("damaged"))


@pytest.mark.parametrize("name", QUERIES)
def test_empty(spark, damaged, name):
    """Empty tables give what SQL gives on them; without SQL, no rows. A sweep still has its thresholds, all rates null."""
    f, sql = QUERIES[name]
    if name in ("warn_sweep", "best_threshold"):
        rows = f(spark, damaged["empty"]).collect()
        assert len(rows) == (16 if name == "warn_sweep" else 1) and all(v is None for r in rows for k, v in r.asDict().items() if k != "threshold")
    elif sql:
        same(f(spark, damaged["empty"]), connect(damaged["empty"]), sql)
    else:
        assert f(spark, damaged["empty"]).count() == 0


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_nulls(spark, damaged, name):
    f, sql = QUERIES[name]
    same(f(spark, damaged["nulls"]), connect(damaged["nulls"]), sql)
