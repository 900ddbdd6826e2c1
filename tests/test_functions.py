"""Scalar rules, with values written by hand."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ligature.functions import messages, profile, text
from ligature.functions.similarity import email_similarity


def one(spark, expr, schema, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {schema}").select(expr(F.col("x"))).collect()]


def test_clean(spark):
    assert one(spark, text.clean, "string", " N/A ", "null", "-", "Unknown", " x ", None, "", "\xa0y　", "a b") == ["", "", "", "", "x", "", "", "y", "a b"]


def test_normal(spark):
    assert one(spark, text.normal, "string", " AB\t", "none", None, " - ", "\n") == ["ab", None, None, None, "\n"]


def test_email_pattern(spark):
    assert one(spark, text.email_pattern, "string", "12345@x", "ann.lee@x", "annlee@x", "ann1@x", "a_b@x", "nope", "@x", None) == ["all-digits", "name.surname", "all-alpha", "alpha+digits", "other", "", "", ""]


def test_names(spark):
    rows = spark.createDataFrame([("Ann", "", "Lee", None), (None, None, None, None), ("A", "B", "C", " Full ")], "f string, m string, l string, n string")
    c = [F.col(x) for x in "fml"]
    assert [tuple(r) for r in rows.select(text.display_name(*c, F.col("n")), text.full_name(*c), text.local_part(F.lit("a@b@c"))).collect()] == [("Ann Lee", "Ann Lee", "a"), ("", None, "a"), ("Full", "A B C", "a")]


def test_messages(spark):
    m = "Risk: 87.5 %, High risk"
    assert one(spark, messages.risk_score, "string", m, "nothing", None, "risk: 1.2.3 %") == [87.5, None, None, None]
    assert one(spark, messages.risk_band, "string", m, "nothing", None) == ["high", "", ""]
    html = "<li>Author: A\nB</li><li>Company:  n/a </li> does not match, matches the author"
    assert one(spark, lambda c: messages.document_field(c, "Author"), "string", html, None) == ["A\nB", ""]
    assert one(spark, lambda c: messages.document_field(c, "Company"), "string", html) == [""]
    assert one(spark, messages.document_match, "string", html, "matches the author", "other", None) == [False, True, None, None]
    assert one(spark, messages.status_name, "int", 1, 3, 8, None) == ["green", "red", "", ""]


def test_ratio(spark):
    values = [1.25, 2.0, 1.3333333730697632, 100.0, 0.5, 0.0, 1e-5, 123456.0, 1234567.0, None]
    assert one(spark, profile.ratio_text, "double", *values) == ["" if v is None else f"{v:g}" for v in values]
    assert one(spark, profile.ratio_text, "string", " x ", None) == ["x", ""]


def test_profile(spark):
    fields = ["canvas_hash", "webgl_hash", "hw_id_hash", "ua_family_hash", "platform", "screen_width", "screen_height", "device_pixel_ratio", "device_id"]
    schema = ", ".join(f"{f} {'int' if 'screen' in f else 'double' if 'ratio' in f else 'string'}" for f in fields)
    full = "f" * 64
    rows = [("a", "b", "c", "d", "e", 10, 20, 1.5, None), (None, None, None, None, None, 10, None, None, full), (None, " ", None, None, None, None, None, None, "short"), ("a", None, None, None, None, None, None, None, None)]
    got = spark.createDataFrame(rows, schema).select(profile.profile_key().alias("k"), profile.device_token().alias("t"), profile.device_token(True).alias("s"), F.size(profile.profile_errors()).alias("n")).collect()
    assert [r.k for r in got] == ["a|b|c|d|e|10x20|1.5", "", "", "a||||||"]
    assert [len(r.t) for r in got] == [16, 16, 0, 16] and got[1].t == "f" * 16
    assert [r.s != "" for r in got] == [True, False, False, False]
    assert [r.n for r in got] == [0, 7, 8, 7]


def test_similarity(spark):
    import re

    def brute(name, email):
        def n(x):
            return re.sub("[^a-z0-9]+", "", (x or "").lower())

        local = n(email.split("@")[0]) if email and "@" in email else ""
        if not n(name) or not local:
            return 0.0
        return max(SequenceMatcher(None, t, local).ratio() for t in [n(name), *(n(w) for w in name.split())] if t) * 100

    rows = [("Ann Lee", "ann.lee@x"), ("Ann Lee", "lee@x"), ("tide", "diet@x"), ("diet", "tide@x"), ("", "a@x"), (None, None), ("Ann", "nope"), ("Ann Lee", "ann.lee@x")]
    got = email_similarity(spark.createDataFrame(rows, "n string, e string"), "n", "e").collect()
    assert sorted(r.name_email_sim for r in got) == pytest.approx(sorted(brute(*r) for r in rows))
