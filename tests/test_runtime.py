"""Checkpoints that are released, and joins that deal out hot keys."""

import os

from pyspark.sql import functions as F

from ligature.runtime import cut, hot_limit, join_counted, release, stored


def test_hot_keys_are_few():
    assert hot_limit(10, 100) == 100 and hot_limit(10_000_000, 1, keys=1000) == 10_000


def test_join_counted(spark):
    rows = cut(spark.range(4000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("x")).repartition(4))
    counted = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("m"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = join_counted(rows, counted, ["k"], 4000, least=100)
        assert sorted(map(tuple, got.select("k", "x", "n", "m").collect())) == sorted(map(tuple, rows.join(counted, "k").select("k", "x", "n", "m").collect()))
        # A third of all rows would be 1,333 in one task.
        most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most < 700
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_release(spark):
    df = cut(spark.range(10))
    path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.exists(path)
    release(df)
    assert not os.path.exists(path)
    release(spark.range(3))


def test_stored_until_the_source_changes(spark, tmp_path):
    source, made = str(tmp_path / "s"), []
    make = lambda: made.append(1) or spark.read.parquet(source).withColumn("y", F.col("id") + 1)
    spark.range(3).write.parquet(source)
    assert stored(spark, "t", [source], make).count() == 3 == stored(spark, "t", [source], make).count() and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    assert stored(spark, "t", [source], make).count() == 5 and len(made) == 2
