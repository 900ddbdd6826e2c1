"""Sinks: tables that replace what was read, exports and sidecars."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _paths(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = [jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.old")]
    return (at[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *at)


def recover(spark: SparkSession, path: str) -> None:
    """Put back what :func:`replace_table` left aside if it was stopped between its two renames."""
    fs, target, _, old = _paths(spark, path)
    if not fs.exists(target) and fs.exists(old):
        fs.rename(old, target)


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside ``path`` and swap, so that ``df`` may read from it and a failed write leaves it as it was.

    If the swap is stopped midway, the table lies at ``path.old`` until the next call, or :func:`recover`, puts it back; the
    old table is deleted only when the new one is in its place.
    """
    spark = df.sparkSession
    recover(spark, path)
    fs, target, new, old = _paths(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    if fs.exists(target):
        fs.delete(old, True)
        if not fs.rename(target, old):
            raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, target):
        raise OSError(f"{path}.new can't be moved to its place")
    fs.delete(old, True)


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``, or no rows of the same schema where there is none."""
    recover(spark, path)
    fs, target, _, _ = _paths(spark, path)
    return spark.read.schema(like.schema).parquet(path) if fs.exists(target) else like.limit(0)


def export_snapshot(derived: DataFrame, index: DataFrame, hubs: DataFrame, folder: str) -> None:
    """Articles, hub entries with their members, each as compressed JSON lines, written by all executors."""
    articles = derived.join(index.select("article_id").distinct(), "article_id", "left_semi")
    members = index.groupBy("attr", "value").agg(F.array_sort(F.collect_list("article_id")).alias("article_ids"))
    for name, df in (("articles", articles), ("index", members.join(hubs, ["attr", "value"]))):
        df.write.mode("overwrite").option("compression", "gzip").json(f"{folder}/{name}")


def load_snapshot(spark: SparkSession, folder: str, schemas: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Articles and hub entries of an export; with ``schemas`` only the columns named there, and no pass to infer them."""
    names = ("articles", "index")
    readers = [spark.read.schema(s) for s in schemas] if schemas else [spark.read] * 2
    return tuple(r.json(f"{folder}/{n}") for r, n in zip(readers, names))


def sidecar(meta: DataFrame, built: str, window_days: int) -> str:
    """One line of JSON from a one-row table of counts; the instant is given, never the clock."""
    return json.dumps({"builtUtc": built, "windowDays": window_days, **meta.first().asDict()}, separators=(",", ":"))


def write_csv(df: DataFrame, path: str) -> None:
    """Rows with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def report_json(sections: dict[str, DataFrame]) -> str:
    """Small result tables as one JSON document; every section is an aggregate of bounded size."""
    return json.dumps({k: [r.asDict(recursive=True) for r in df.collect()] for k, df in sections.items()}, default=str)
