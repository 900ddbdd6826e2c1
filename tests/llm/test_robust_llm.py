"""Every query of the subpackage on empty tables and on tables full of nulls."""

import pytest

from compare import connect, same
from damage import copies
from ligature.llm import queries


@pytest.fixture(scope="module")
def damaged(spark, sf, tmp_path_factory):
    return copies(spark, sf, tmp_path_factory.mktemp("damaged"))


@pytest.mark.parametrize("name", queries.queries())
def test_empty(spark, damaged, name):
    assert queries.queries()[name](spark, damaged["empty"]).count() == 0


@pytest.mark.parametrize("name", queries.queries())
def test_nulls(spark, damaged, name):
    df = queries.queries()[name](spark, damaged["nulls"])
    if name in queries.oracle_sql() and name != "p7_decoded":  # null ids are decoded too, in any order
        same(df, connect(damaged["nulls"]), queries.oracle_sql()[name])
    else:
        df.count()
