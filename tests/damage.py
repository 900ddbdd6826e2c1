"""Copies of the test tables without rows, or with half of all values null and clashing extra columns."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

EXTRA = ("n", "size", "value", "attr", "block", "slot", "df", "term", "word", "score", "rank", "_run", "_p", "_v")


def copies(spark, sf: str, to: Path) -> dict[str, str]:
    for f in Path(sf).glob("*.parquet"):
        df = spark.read.parquet(str(f))
        df.limit(0).coalesce(1).write.parquet(str(to / "empty" / f.name))
        half = df.select(*(F.when(F.rand(5 + k) < 0.5, F.col(c)).alias(c) for k, c in enumerate(df.columns)))
        half.withColumns({c: F.lit("x") for c in EXTRA if c not in df.columns and f.stem != "flags"}).coalesce(1).write.parquet(str(to / "nulls" / f.name))
    return {k: str(to / k) for k in ("empty", "nulls")}
