"""Similar sets against all pairs."""

import random
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ligature.llm import setsim


def brute(rows, num=3, den=5, least=4):
    sets = {}
    for k, v in rows:
        if k is not None and v is not None:
            sets.setdefault(k, set()).add(v)
    big = {k: s for k, s in sets.items() if len(s) >= least}
    return {(a, b, len(big[a] & big[b])) for a, b in combinations(sorted(big), 2) if len(big[a] & big[b]) * den >= num * len(big[a] | big[b])}


def found(spark, rows, **kw):
    got = [tuple(r) for r in setsim.similar_pairs(spark.createDataFrame(rows, "id long, value long").repartition(3), **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("hot", [2, 7, 1000])
def test_random(spark, hot):
    rng = random.Random(hot)
    rows = [(None, 1), (1, None)]
    for k in range(300):
        base = rng.randrange(25)
        pool = [base * 100 + j for j in range(7)] + [1, 2, 3, 4, 5, 6]
        rows += [(k, v) for v in rng.sample(pool, rng.randrange(2, 10))]
    assert found(spark, rows + rows[:100], hot=hot) == brute(rows)


def test_only_hot_values(spark):
    rng = random.Random(5)
    rows = [(k, v) for k in range(150) for v in rng.sample(range(8), 5)]
    assert found(spark, rows, hot=3) == brute(rows)


def test_sets_too_large_for_a_row(spark):
    rng = random.Random(6)
    rows = [(k, v) for k in range(12) for v in rng.sample(range(60), 12 + 3 * k)]
    assert found(spark, rows, large=25) == brute(rows) == found(spark, rows)


def test_merging_a_list_needs_no_other_way():
    """Every list is probed by DivideSkip, short ones too."""
    rng = random.Random(3)
    for size in (2, 5, 30):
        sets = {k: tuple(sorted(rng.sample(range(9), rng.randrange(4, 8)))) for k in range(size)}
        want = brute([(k, v) for k, s in sets.items() for v in s])
        got = {p for v in range(9) for p in setsim.merge_list([(k, 2, len(s), s) for k, s in sets.items() if v in s], (v,), 3, 5)}
        assert got == want


def test_values_are_compared_themselves(spark):
    rows = [(k, f"{v}") for k in (1, 2) for v in ("a", "A", "ä", "", " ", "x" * 5000)]
    got = setsim.similar_pairs(spark.createDataFrame(rows, "id long, value string")).collect()
    assert [tuple(r) for r in got] == [(1, 2, 6)]


def test_too_small_sets_are_refused(spark):
    with pytest.raises(ValueError, match="min_size"):
        found(spark, [(1, 1)], min_size=1)


def test_large_list_without_pairs(spark):
    rows = [(k, v) for k in range(400) for v in (0, 1000 + 3 * k, 1001 + 3 * k, 1002 + 3 * k)]
    assert found(spark, rows, hot=1000) == set()


def test_empty(spark):
    assert found(spark, []) == set()


@given(st.lists(st.lists(st.integers(0, 12), max_size=9).map(lambda x: sorted(set(x))), min_size=1, max_size=9), st.integers(1, 6), st.integers(0, 5))
@settings(max_examples=200, deadline=None)
def test_divide_skip(lists, t, long):
    count = Counter(v for x in lists for v in x)
    assert dict(setsim.divide_skip(lists, t, long)) == {v: n for v, n in count.items() if n >= t}


def test_value_sets(spark):
    f = spark.createDataFrame([(1, " A", "z", 7), (1, "a", None, 7), (None, "a", "z", 7), (2, "-", "A", 7)], "article_id long, d string, t string, id int")
    got = setsim.value_sets(f, "article_id", ["d", "t"]).collect()
    assert Counter(r.id for r in got) == {1: 2, 2: 1} and len({r.value for r in got}) == 3
