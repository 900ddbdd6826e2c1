"""Term counts against sets."""

import random
import re

from pyspark.sql import functions as F

from ligature.llm import terms


def test_tags(spark):
    values = ["en-US,en;q=0.9", "zh_CN;zh;en", '["fr-FR","fr"]', "en-US EN", " - ", None, "", "NA", "*", "'de' (at)"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(terms.language_tags(F.col("x"))).collect()]
    assert got == [["en-us", "en"], ["zh-cn", "zh", "en"], ["fr-fr", "fr"], ["en-us", "en"], [], [], [], [], ["*"], ["de", "at"]]


def test_counts(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(200) if rng.random() > 0.05 else None, rng.choice(["HOT", "hot ", "a", "b", None, "n/a", f"x{rng.randrange(80)}"]), rng.choice(["en,de", "en;q=0.5,en", "fr", None]), "clash") for _ in range(3000)]
    f = spark.createDataFrame(rows, "article_id long, h string, l string, id string").repartition(7)
    want = {}
    for a, h, l, _ in rows:
        if a is None:
            continue
        h = None if h is None or h.strip().lower() in ("n/a",) else h.strip().lower()
        toks = [("h", h)] if h else []
        toks += [("l", t) for t in re.split("[,;]", l) if not t.startswith("q=")] if l else []
        for t in toks:
            c = want.setdefault(t, [0, set()])
            c[0] += 1
            c[1].add(a)
    got = terms.frequencies(terms.tokens(f, "article_id", ["h"], ["l"]), 5, bucket_records=1)
    assert {(r.attr_name, r.term): (r.occurrences, r.records) for r in got.collect()} == {k: (n, len(s)) for k, (n, s) in want.items()}


def test_marks(spark):
    f = spark.createDataFrame([("a", "x", 1, 1), ("a", "y", 9, 2), ("a", "z", 9, 3)], "attr_name string, term string, occurrences long, records long")
    assert [r.mark for r in terms.marks(f, 100).orderBy("term").collect()] == ["rare", None, "common"]
    assert [r.mark for r in terms.marks(f, 10).orderBy("term").collect()] == ["rare", "common", "common"]


def test_empty(spark):
    f = spark.createDataFrame([], "article_id long, h string, l string")
    assert terms.frequencies(terms.tokens(f, "article_id", ["h"], ["l"]), 0).count() == 0
