"""Trailing windows, incremental refresh, archive and backfill of a cached table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ligature.schema import conform


def cutoff(as_of: str, days: int) -> Column:
    """The instant ``days`` before ``as_of``, which is given and never the clock."""
    return F.expr(f"TIMESTAMP_NTZ'{as_of}' - INTERVAL '{days}' DAY")


def within(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows of the window, its edge included; null times are outside. A plain comparison, pushed to the scan."""
    return df.where(F.col(ts) >= cutoff(as_of, days))


def aged(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """The complement of :func:`within`; null times are here."""
    return df.where(F.coalesce(F.col(ts) < cutoff(as_of, days), F.lit(True)))


def keep_by_priority(df: DataFrame, key: str, priority: str, first: bool = True, ties: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: the one with the smallest (or largest) priority, ties by the other columns."""
    order = [F.asc(priority) if first else F.desc(priority), *(F.asc_nulls_last(t) for t in ties)]
    by = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r", priority)


def splice(cache: DataFrame, fresh: DataFrame, key: str, ts: str, as_of: str, days: int, schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """The refreshed window and what aged out of the cache: fresh rows win, cached ones stay where there is none. Both sides are conformed to ``schema`` if one is given."""
    if schema is not None:
        cache, fresh = conform(cache, schema), conform(fresh, schema)
    remainder = within(cache, ts, as_of, days).join(fresh.select(key).distinct(), key, "left_anti")
    merged = fresh.withColumn("_p", F.lit(0)).unionByName(remainder.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    others = tuple(c for c in cache.columns if c != key)
    return within(keep_by_priority(merged, key, "_p", ties=others), ts, as_of, days), aged(cache, ts, as_of, days)


def archive(previous: DataFrame, aged_out: DataFrame, key: str, schema: T.StructType | None = None) -> DataFrame:
    """Previous and newly aged rows, each key once; the newer row wins. Both are conformed to ``schema`` if one is given."""
    if schema is not None:
        previous, aged_out = conform(previous, schema), conform(aged_out, schema)
    both = previous.withColumn("_p", F.lit(0)).unionByName(aged_out.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return keep_by_priority(both, key, "_p", first=False, ties=tuple(c for c in previous.columns if c != key))


def replace_columns(df: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with every column that ``new`` has taken from it, null where the key is missing there; columns of ``df`` named in ``keep`` stay. Key must be unique in ``new``."""
    taken = new.drop(*(c for c in keep if c in df.columns))
    return df.drop(*(c for c in taken.columns if c != key)).join(taken, key, "left")


def needs_backfill(columns: tuple[str, ...], empty) -> Column:
    """Whether any of the columns is empty."""
    need = F.lit(False)
    for c in columns:
        need = need | empty(F.col(c))
    return need


def fill_if_empty(df: DataFrame, new: DataFrame, key: str, columns: tuple[str, ...], empty) -> DataFrame:
    """``df`` with empty values of the columns taken from ``new``; others stay. Key must be unique in ``new``."""
    other = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = df.join(other, key, "left")
    filled = {c: F.when(empty(F.col(c)), F.coalesce(F.col(f"_new_{c}"), F.col(c))).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(filled).drop(*(f"_new_{c}" for c in columns))


def shifted(name_email_org: tuple[str, str, str] = ("author_name", "author_email", "author_org")) -> Column:
    """Whether the organisation holds an address and the e-mail none."""
    _, email, org = name_email_org
    has = lambda c: F.contains(F.coalesce(F.col(c), F.lit("")), F.lit("@"))
    return has(org) & ~has(email)


def rotate_shifted(df: DataFrame) -> DataFrame:
    """Rows whose columns slipped by one are put back: name from e-mail, e-mail from organisation, organisation empty."""
    bad = shifted()
    old = {"author_name": F.col("author_email"), "author_email": F.col("author_org"), "author_org": F.lit("")}
    return df.select(*(F.when(bad, old[c]).otherwise(F.col(c)).alias(c) if c in old else F.col(c) for c in df.columns))
