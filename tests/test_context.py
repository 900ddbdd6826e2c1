"""The context star on hand-made warehouse tables."""

import datetime as dt

from ligature.sources import context

T = lambda n: dt.datetime(2001, 1, n)


def tables(spark):
    f = spark.createDataFrame
    return {
        "articles": f([(1, "one", 1, 1, 1, 7, 1, None, T(20)), (2, "two", 1, None, 1, 8, None, False, T(20)), (3, "gone", 1, None, 1, 7, 1, True, T(20)), (4, "old", 1, None, 1, 7, 1, None, T(1))], "article_id long, title string, stage_id int, reason_id int, type_id int, space_id int, path_id int, is_deleted boolean, submitted timestamp_ntz"),
        "stages": f([(1, "Review")], "stage_id int, name string"), "reasons": f([(1, "Scope", "S")], "reason_id int, name string, code string"), "types": f([(1, 7, "Letter")], "type_id int, space_id int, name string"),
        "paths": f([(1, 5, None)], "path_id int, journal_id int, section_id int"), "journals": f([(5, "J")], "journal_id int, name string"), "sections": f([(6, "S")], "section_id int, name string"),
        "authors": f([(1, 10, "A", None, "First", False, True, 1, 100), (1, 11, "B", "M", "Second", True, None, 2, 101), (2, 12, None, None, None, None, None, 1, None)], "article_id long, author_id int, first_name string, middle_name string, last_name string, is_submitting boolean, is_corresponding boolean, order int, email_id int"),
        "emails": f([(100, None, "a@x", None, None), (101, None, "B@X", None, None), (102, 1, "old@x", True, T(1)), (103, 1, "new@x", True, T(2)), (104, 1, "no@x", False, T(3))], "email_id int, user_id int, email string, is_primary boolean, modified timestamp_ntz"),
        "affiliations": f([(11, 2, 51), (11, 1, 50), (10, 2, 51)], "author_id int, order int, organisation_id int"), "organisations": f([(50, "Org"), (51, "Other")], "organisation_id int, name string"),
        "users": f([(1, None, None, None, T(2)), (1, "X", "", "Y", T(1)), (2, "Ann ", None, " Lee", T(1)), (3, "C", None, "D", T(1)), (4, "B", None, "E", T(1))], "user_id int, first_name string, middle_name string, last_name string, modified timestamp_ntz"),
        "editors": f([(1, 1, None, 1), (1, 2, None, 1), (1, 3, None, 1), (1, 4, None, 1), (2, 2, T(1), 1), (2, 3, None, 2)], "article_id long, user_id int, revoked timestamp_ntz, status int"),
        "reviewers": f([(1, 2, T(1), 2), (1, 3, T(1), 1), (1, 4, None, 3), (1, 9, None, 1)], "article_id long, user_id int, ended timestamp_ntz, status int"),
    }


def test_context(spark):
    rows = {r.article_id: r for r in context.article_context(tables(spark), "2001-01-31 00:00:00", 20).collect()}
    assert set(rows) == {1, 2}
    one, two = rows[1], rows[2]
    assert tuple(one) == (1, "one", 1, "Review", "Scope", "S", "Letter", "J", None, "B M Second", "b@x", "Org", "Ann Lee,B E,C D", "Ann Lee")
    assert (two.article_type, two.journal, two.author_name, two.author_email, two.editors, two.reviewers) == (None, None, "", "", None, None)
    assert context.status_and_journal(context.article_context(tables(spark), "2001-01-31 00:00:00", 20)).count() == 2


def test_empty(spark):
    t = tables(spark)
    t["articles"] = t["articles"].limit(0)
    assert context.article_context(t, "2001-01-31 00:00:00", 20).count() == 0
