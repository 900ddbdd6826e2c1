"""Latest, first and best row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_row(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``. The order should be total; null keys form a group of their own."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= n).drop("_rank")


def latest_row(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The row with the largest ``ts``, then ``tie``; a null time is older than any other."""
    return best_row(df, keys, [F.desc_nulls_last(ts), F.desc_nulls_last(tie)])


def latest_non_null(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """For each column its last value that isn't null, in ascending ``order``; values may come from different rows."""
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns))


def first_non_null(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """For each column its first value that isn't null, in ascending ``order``."""
    place = F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)))
    return df.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns))


def ordered_list(df: DataFrame, keys: list[str], value: Column, limit: int, name: str, separator: str = ",") -> DataFrame:
    """The first ``limit`` distinct values of each key in ascending order, joined."""
    distinct = df.select(*keys, value.alias("_v")).where("_v is not null").distinct()
    kept = best_row(distinct, keys, [F.col("_v")], limit)
    return kept.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("_v")), separator).alias(name))
