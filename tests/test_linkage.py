"""Caps, scores, hubs and flags on small corpora made by hand."""

import datetime as dt

import pytest
from ligature.operators import evaluate, hubs, pairs, tokens

COLS = "article_id long, created_on date, author_name string, author_org string, wd_status string, " + ", ".join(f"{a} string" for a in tokens.CAPS)


def corpus(spark, rows):
    base = dict.fromkeys(tokens.CAPS, "")
    out = [tuple({"created_on": dt.date(2001, 1, 1), "author_name": "n", "author_org": "o", "wd_status": "", **base, **r}[c.split()[0]] for c in COLS.split(", ")) for r in rows]
    return spark.createDataFrame(out, COLS)


def test_caps(spark):
    rows = [{"article_id": i, "ip": v, "locale": "only"} for i, v in enumerate(["one", "two", "two", "cap", "cap", "cap", "over", "over", "over", "over"])]
    kept = tokens.kept(tokens.unpivot(corpus(spark, rows)), {**tokens.CAPS, "ip": 3, "locale": 100})
    assert {r.value for r in kept.collect()} == {"two", "cap", "only"}
    assert sorted(r.article_id for r in tokens.connected(kept).collect()) == [1, 2, 3, 4, 5]


def test_raising_a_cap_loses_nothing(spark):
    rows = [{"article_id": i, "ip": str(i % 3)} for i in range(12)]
    t = tokens.unpivot(corpus(spark, rows))
    few, many = ({r.value for r in tokens.kept(t, {**tokens.CAPS, "ip": c}).collect()} for c in (3, 4))
    assert few <= many


def test_generic_document_values(spark):
    t = tokens.unpivot(corpus(spark, [{"article_id": 1, "wd_author": "Admin", "wd_company": "Dell", "ip": "admin"}]))
    assert [(r.attr, r.value) for r in t.collect()] == [("ip", "admin")]


@pytest.mark.parametrize(
    ("shared", "orgs", "days", "score"),
    [
        (("device", "ip", "wd_author", "wd_edited_by"), ("a", "b"), 7, 41.0),
        (("device", "ip", "wd_author", "wd_company"), ("a", "b"), 31, 38.0),
        (("ip",), ("a", "a"), 31, 6.0),
        (("locale", "email"), ("a", "b"), 7, 2.0),
        (("ip",), ("", "b"), 8, 8.5),
        (("ip",), ("a", "b"), 30, 10.5),
    ],
)
def test_scores(spark, shared, orgs, days, score):
    rows = [{"article_id": i, "author_org": orgs[i], "created_on": dt.date(2001, 1, 1) + dt.timedelta(days=days * i), **dict.fromkeys(shared, "v")} for i in (0, 1)]
    got = pairs.scored_pairs(tokens.index(corpus(spark, rows))).collect()
    assert [(r.a, r.b, r.score) for r in got] == [(0, 1, score)]


def test_hubs(spark):
    rows = [{"article_id": i, "ip": "five", "author_name": "ab"[i > 1], "author_org": "xy"[i % 2]} for i in range(5)]
    rows += [{"article_id": 10 + i, "ip": "four", "author_name": "ab"[i % 2], "author_org": "xy"[i % 2]} for i in range(4)]
    rows += [{"article_id": 20 + i, "ip": "one org", "author_name": "ab"[i % 2]} for i in range(6)]
    rows += [{"article_id": 30 + i, "ip": "half", "author_name": ["a", "b", "a", "b", "a", "b"][i], "author_org": "xy"[i % 2]} for i in range(6)]
    index = tokens.index(corpus(spark, rows))
    assert {r.value for r in hubs.eligible(hubs.stats(index)).collect()} == {"five", "half"}
    passed = {r.article_id for r in hubs.passing(index).collect()}
    assert passed == {0, 1, *range(30, 36)}  # b holds 3 of 5 in the first; exactly half passes


def test_flags(spark):
    t = lambda n: dt.datetime(2001, 1, n)
    rows = [(1, "active", t(1), None), (2, "active", t(1), None), (2, "removed", t(1), t(2)), (3, "removed", t(1), t(2)), (3, "active", t(3), None), (None, "active", t(1), None)]
    f = spark.createDataFrame(rows, "article_id long, status string, flagged_at timestamp, removed_at timestamp")
    assert sorted(r.article_id for r in tokens.flagged(f).collect()) == [1, 3]


def test_flagged_matches(spark):
    both = {"wd_author": "w", "ip": "i"}
    derived = corpus(spark, [{"article_id": 1, **both}, {"article_id": 2, **both}, {"article_id": 3, "device": "d"}, {"article_id": 4, "device": "d", "ip": "x"}])
    flags = spark.createDataFrame([(2,), (4,)], "article_id long")
    got = evaluate.chips(evaluate.flagged_matches(derived, flags)).collect()
    assert [(r.subject, r.peer, r.match_total, r.chips) for r in got] == [(1, 2, 1, "ip+wd_author")]
    assert evaluate.flagged_matches(derived, flags.where("article_id = 4")).count() == 0


def test_empty(spark):
    none = corpus(spark, [{"article_id": 1}]).where("article_id < 0")
    index = tokens.index(none)
    assert pairs.scored_pairs(index).count() == 0 and hubs.passing(index).count() == 0


def test_order_of_input_changes_nothing(spark):
    rows = [{"article_id": i, "ip": str(i % 4), "device": str(i % 3), "author_org": str(i % 2)} for i in range(20)]
    a, b = (sorted(map(tuple, pairs.top_peers(pairs.scored_pairs(tokens.index(corpus(spark, r)))).collect())) for r in (rows, rows[::-1]))
    assert a == b and a


def test_plans(spark):
    rows = [{"article_id": i, "ip": str(i % 4)} for i in range(20)]
    plan = pairs.scored_pairs(tokens.index(corpus(spark, rows)))._jdf.queryExecution().toString()
    assert "EvalPython" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_what_is_needed(spark, sf):
    from ligature.plans import linkage, sourcing

    columns = linkage.token_df(spark, sf)._jdf.queryExecution().sparkPlan().collectLeaves().head().output().mkString(" ")
    assert "device_pixel_ratio" in columns and not any(c in columns for c in ("article_title", "editors", "journal"))
    plan = sourcing.recent_articles_window(spark, sf)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(created" in plan and "EqualTo(resource_type_definition_id,1)" in plan
