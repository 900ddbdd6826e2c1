"""Latest rows, windows, archive, backfill, sources, sinks and the stream."""

import datetime as dt
import glob
import json
import os

from pyspark.sql import functions as F

from ligature.operators import latest, refresh
from ligature.schema import ARTICLES, conform
from ligature.sources import sinks, tables
from ligature.streaming import mirror

T = lambda n: dt.datetime(2001, 1, n)
AS_OF = "2001-01-31 00:00:00"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, T(1), "x"), (1, 2, T(2), None), (2, 3, None, "y"), (2, 4, T(1), "z"), (2, 5, T(1), "t")], "k int, id int, t timestamp_ntz, v string")
    assert rows(latest.latest_row(df, ["k"], "t", "id").select("k", "v")) == [(1, None), (2, "t")]
    assert rows(latest.latest_non_null(df, ["k"], ["t", "id"], ["v"])) == [(1, "x"), (2, "t")]
    assert rows(latest.first_non_null(df, ["k"], [F.col("id")], ["v"])) == [(1, "x"), (2, "y")]
    assert rows(latest.ordered_list(df, ["k"], F.col("v"), 2, "vs")) == [(1, "x"), (2, "t,y")]
    assert latest.latest_row(df.limit(0), ["k"], "t", "id").count() == 0


def cache(spark, *r):
    return spark.createDataFrame(list(r), "article_id long, created timestamp_ntz, v string")


def test_splice_and_archive(spark):
    old = cache(spark, (1, T(1), "a"), (2, T(11), "edge"), (3, T(20), "old"), (4, None, "none"))
    new = cache(spark, (3, T(20), "new"), (5, T(30), "new"))
    merged, gone = refresh.splice(old, new, "article_id", "created", AS_OF, 20)
    assert [(r[0], r[2]) for r in rows(merged)] == [(2, "edge"), (3, "new"), (5, "new")]
    assert [r[0] for r in rows(gone)] == [1, 4]
    kept = refresh.archive(cache(spark, (1, T(1), "first"), (9, T(1), "first")), gone, "article_id")
    assert [(r[0], r[2]) for r in rows(kept)] == [(1, "a"), (4, "none"), (9, "first")]
    again, _ = refresh.splice(merged, new, "article_id", "created", AS_OF, 20)
    assert rows(again) == rows(merged)


def test_backfill(spark):
    a = spark.createDataFrame([(1, "", "o@x", "k"), (2, "e@x", "org", "k"), (3, None, "a@b", "k")], "article_id long, author_email string, author_org string, author_name string")
    new = spark.createDataFrame([(1, "n@x"), (2, "other")], "article_id long, author_email string")
    assert [r.author_email for r in refresh.fill_if_empty(a, new, "article_id", ("author_email",), lambda c: F.coalesce(c, F.lit("")) == "").orderBy("article_id").collect()] == ["n@x", "e@x", None]
    assert [r.author_email for r in refresh.replace_columns(a, new, "article_id").orderBy("article_id").collect()] == ["n@x", "other", None]
    got = refresh.rotate_shifted(a).orderBy("article_id").collect()
    assert [(r.author_name, r.author_email, r.author_org) for r in got] == [("", "o@x", ""), ("k", "e@x", "org"), (None, "a@b", "")]


def test_conform(spark):
    df = conform(spark.createDataFrame([("7", "x", 1)], "article_id string, author_name string, extra int"), ARTICLES)
    r = df.first()
    assert len(df.columns) == 34 and r.article_id == 7 and r.author_name == "x" and r.journal is None


def test_sources(spark):
    c = tables.parse_connection("Server=tcp:h,1433;UID = u;pwd=p=q;Encrypt=yes", "main")
    assert c == {"server": "tcp:h,1433", "user": "u", "password": "p=q", "encrypt": "yes", "database": "main"}
    assert tables.jdbc(spark, "Server=h;Database=d", "select 1") is not None
    assert rows(tables.flag_ids(spark.createDataFrame([("1",), ("x",), (None,), ("1",)], "k string"), "k")) == [(1,)]
    assert rows(tables.run_sql(spark, "select sum(a) from t1", {"t1": spark.range(4).withColumnRenamed("id", "a")})) == [(6,)]


def test_authors(spark):
    a = spark.createDataFrame([(1, None, None, "B", "b@x", None, "Author", "9.9"), (1, "A", None, None, None, "o", "Submitting author", " ")], "article_id long, first_name string, middle_name string, last_name string, email string, organisation string, role string, ip_address string")
    assert rows(tables.primary_author(a)) == [(1, "A", None, "B", "b@x", "o", " ")]
    assert rows(tables.author_ip(a)) == [(1, "9.9")]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(cache(spark, (1, T(1), "a")), path)
    sinks.replace_table(spark.read.parquet(path).unionByName(cache(spark, (2, T(1), "b"))), path)
    assert spark.read.parquet(path).count() == 2
    meta = sinks.sidecar(spark.range(1).select(F.lit(3).alias("count")), "2001-01-01T00:00:00", 90)
    assert json.loads(meta) == {"builtUtc": "2001-01-01T00:00:00", "windowDays": 90, "count": 3}
    sinks.write_csv(cache(spark, (1, T(1), "a")), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().v == "a"
    assert json.loads(sinks.report_json({"x": spark.range(2)})) == {"x": [{"id": 0}, {"id": 1}]}


def test_snapshot(spark, tmp_path):
    derived = spark.createDataFrame([(1, "t"), (2, "u"), (3, "v")], "article_id long, title string")
    index = spark.createDataFrame([("ip", "x", 2), ("ip", "x", 1)], "attr string, value string, article_id long")
    hub = spark.createDataFrame([("ip", "x", 2)], "attr string, value string, size long")
    sinks.export_snapshot(derived, index, hub, str(tmp_path))
    articles, hubs = sinks.load_snapshot(spark, str(tmp_path))
    assert sorted(r.article_id for r in articles.collect()) == [1, 2] and hubs.first().article_ids == [1, 2]


def test_mirror(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("src", "out", "chk"))
    schema = "id long, article_id long, ts timestamp_ntz, v string"
    spark.createDataFrame([(1, 1, T(1), "a"), (2, 1, T(2), "b")], schema).write.parquet(src)
    start = lambda: mirror.start_mirror(spark.readStream.schema(schema).parquet(src), out, chk, "article_id", "ts", "id").awaitTermination()
    start()
    spark.createDataFrame([(3, 1, T(1), "late"), (4, 2, T(3), "c")], schema).write.mode("append").parquet(src)
    start()
    table = lambda: [(r.article_id, r.v) for r in mirror.read_mirror(spark, out, spark.createDataFrame([], schema)).orderBy("article_id").collect()]
    assert table() == [(1, "b"), (2, "c")]
    # Only the parts that a batch touches are written.
    others = {p: os.path.getmtime(p) for p in glob.glob(f"{out}/part*") if not p.endswith(f"part{part(spark, 2)}")}
    mirror.reconcile(spark, spark.createDataFrame([(5, 2, T(4), "d"), (1, 2, T(1), "x")], schema), out, "article_id", "ts", "id")
    assert table() == [(1, "b"), (2, "d")] and others == {p: os.path.getmtime(p) for p in others}


def part(spark, key):
    return spark.createDataFrame([(key,)], "k long").select(mirror.part_of("k")).first()[0]


def test_a_stopped_swap_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(cache(spark, (1, T(1), "a")), path)
    os.rename(path, f"{path}.old")  # as after the first of the two renames
    assert sinks.read_or_empty(spark, path, cache(spark, (1, T(1), "a"))).count() == 1
    os.rename(path, f"{path}.old")
    sinks.replace_table(cache(spark, (2, T(1), "b")), path)
    assert [r.v for r in spark.read.parquet(path).collect()] == ["b"] and not os.path.exists(f"{path}.old")


def test_stream_windows(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "id long, k string, ts timestamp"
    spark.createDataFrame([(1, "a", T(1)), (1, "a", T(1)), (2, "a", T(1)), (3, "a", T(30))], schema).write.parquet(src)
    stream = mirror.windowed_counts(mirror.distinct_events(spark.readStream.schema(schema).parquet(src), "id", "ts").select("k", "ts"), ["k"], "ts", lateness=None)
    q = stream.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.k, r.n) for r in spark.table("windows").collect()] == [("a", 2)]


def test_spread_leaves_shuffles_alone(spark, tmp_path):
    from ligature.runtime import spread

    path = str(tmp_path / "one")
    spark.range(10).coalesce(1).write.parquet(path)
    one = spark.read.parquet(path)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one).count() == 10
    grouped = one.groupBy("id").count()
    assert spread(grouped) is grouped
