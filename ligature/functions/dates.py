"""Dates and times in strings, leniently: what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = r"^\d{4}-\d{2}-\d{2}"
ZONE = r"(?:[Zz]|[+-]\d{2}:?\d{2})$"


def lenient_date(text: Column) -> Column:
    """The date in the first ten characters of a string, or null if it is shorter or holds none."""
    return F.when(text.rlike(DAY), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def naive_utc(text: Column) -> Column:
    """The instant in an ISO string as a time without zone in UTC: a string without zone is UTC already. Null if it can't be read."""
    there = text.rlike(DAY)
    zoned = F.when(text.rlike(ZONE) & (F.length(text) > 10), text).otherwise(F.concat(F.when(F.length(text) == 10, F.concat(text, F.lit(" 00:00:00"))).otherwise(text), F.lit("Z")))
    micros = F.unix_micros(F.try_to_timestamp(F.when(there, zoned)))
    whole = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / F.lit(1_000_000).cast("decimal(18,0)")).cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + whole
