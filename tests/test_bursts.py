"""Bursts against brute force."""

import datetime as dt
import random

import numpy as np

from ligature.operators import bursts as module
from ligature.operators.bursts import accumulate, bursts

SCHEMA = "id long, last_enrich_utc timestamp_ntz, asn_hash string, ip_hash string, n string, block string"


def brute(rows, attrs, gap=600, least=4):
    once = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            key = (r[1], *(x or "" for x in r[2:4]))
            if r[0] not in once or key < once[r[0]][0]:
                once[r[0]] = (key, r)
    out = set()
    for k, attr in enumerate(attrs):
        by = {}
        for _, r in once.values():
            v = (r[2 + k] or "").strip(" \t").lower()
            if v not in ("", "na", "n/a", "none", "nan", "null", "unknown", "-"):
                by.setdefault(v, []).append((r[1], r[0]))
        for v, events in by.items():
            events.sort()
            run = [events[0]]
            for e in [*events[1:], (dt.datetime.max, 0)]:
                if (e[0] - run[-1][0]).total_seconds() > gap:
                    if len(run) >= least:
                        out.add((attr, v, run[0][1]))
                    run = []
                run.append(e)
    return out


def check(spark, rows, **how):
    got = bursts(spark.createDataFrame(rows, SCHEMA).repartition(5), ("asn_hash", "ip_hash"), **how)
    assert {(r.attr_name, r.key_value, r.first_id) for r in got.collect()} == brute(rows, ("asn_hash", "ip_hash"))


def test_random(spark):
    rng = random.Random(7)
    start = dt.datetime(1969, 12, 30)
    rows = []
    for i in range(4000):
        t = start + dt.timedelta(seconds=rng.choice([0, 600, 1200, 86400]) * rng.randrange(40) + rng.randrange(0, 5) * 200)
        rows.append((i, t if rng.random() > 0.02 else None, "HOT " if rng.random() < 0.4 else rng.choice("abcdefgh-"), f"ip{rng.randrange(300)}" if rng.random() > 0.1 else None, "x", "y"))
    rows += [*rng.sample(rows, 300), (None, start, "a", "b", "", "")]
    check(spark, rows)
    # Blocks of more rows than a split are dealt out; blocks of one slot have edges everywhere.
    check(spark, rows, split_rows=10)
    check(spark, rows, split_rows=50, block_slots=1)


def test_gap_is_inclusive_and_ties_go_by_id(spark):
    t = dt.datetime(2001, 1, 1)
    rows = [(9, t, "a", "b", "", ""), (3, t, "a", "b", "", ""), (4, t + dt.timedelta(seconds=600), "a", "b", "", ""), (5, t + dt.timedelta(seconds=1200), "a", "b", "", ""), (6, t + dt.timedelta(seconds=1801), "a", "b", "", "")]
    check(spark, rows)
    assert brute(rows, ("asn_hash", "ip_hash")) == {("asn_hash", "a", 3), ("ip_hash", "b", 3)}


def test_run_over_many_blocks(spark):
    t = dt.datetime(2001, 1, 1, 20)
    check(spark, [(i, t + dt.timedelta(seconds=590 * i), "long", f"u{i}", "", "") for i in range(700)])


def test_arrays_against_plain_counting():
    rng = np.random.default_rng(5)
    n, pairs, width = 5000, 300, 7
    pair, slot, t, own = rng.integers(0, pairs, n), rng.integers(0, width, n), rng.integers(-50, 50, n), rng.permutation(n)
    want = {}
    for p, s, x, i in zip(pair.tolist(), slot.tolist(), t.tolist(), own.tolist()):
        want.setdefault((p, s), []).append((x, i))
    old, module.ARRAY_CELLS = module.ARRAY_CELLS, 500
    try:
        got = {(p, s): (k, f, i, m) for part in accumulate(pair, slot, t, own, pairs, width) for p, s, k, f, i, m in zip(*(c.tolist() for c in part))}
    finally:
        module.ARRAY_CELLS = old
    assert got == {k: (len(v), *min(v), max(v)[0]) for k, v in want.items()}


def test_no_task_gets_a_hot_key(spark):
    """Half of all rows have one time zone, half of these one day: what is chained by key is far less."""
    t = dt.datetime(2001, 1, 1)
    rows = [(i, t + dt.timedelta(seconds=(i % 4000) * 20 if i % 2 else i * 40), "hot" if i % 2 else f"a{i % 97}", None, "", "") for i in range(8000)]
    check(spark, rows, split_rows=500)


def test_empty(spark):
    assert bursts(spark.createDataFrame([], SCHEMA), ("asn_hash", "ip_hash")).count() == 0
