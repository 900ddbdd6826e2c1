"""The refresh as a stream: late rows, repeated rows and upserts of the latest row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ligature.operators.latest import latest_row
from ligature.runtime import cut, release
from ligature.sources.sinks import read_or_empty, replace_table

#: Late enrichment that is still taken in, as in the batch refresh.
LATENESS = "14 days"


def distinct_events(stream: DataFrame, id_col: str, ts: str, lateness: str = LATENESS) -> DataFrame:
    """The stream with rows of the same id once, within the watermark; state older than that is dropped."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([id_col])


def windowed_counts(stream: DataFrame, keys: list[str], ts: str, width: str = "1 day", lateness: str | None = LATENESS) -> DataFrame:
    """Rows per key and tumbling window, final once the watermark has passed. ``lateness`` None: the stream has a watermark already."""
    marked = stream.withWatermark(ts, lateness) if lateness else stream
    return marked.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


#: Parts a mirrored table is kept in, by a hash of the key.
PARTS = 16


def part_of(key: str, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts).cast("long")).cast("int")


def read_mirror(spark: SparkSession, path: str, like: DataFrame, parts: int = PARTS) -> DataFrame:
    """The mirrored table, all parts together; no rows of the schema of ``like`` where there is none."""
    out = read_or_empty(spark, f"{path}/part0", like)
    for k in range(1, parts):
        out = out.unionByName(read_or_empty(spark, f"{path}/part{k}", like))
    return out


def upsert_latest(path: str, key: str, ts: str, tie: str, parts: int = PARTS):
    """A ``foreachBatch`` function that keeps the latest row per key in the table at ``path``.

    The table lies in parts by a hash of the key; only those that the batch touches are read and written.
    Rows aren't deleted. Running a batch twice changes nothing, so a restart from the checkpoint is safe.
    """

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch)
        for k in sorted(r[0] for r in rows.select(part_of(key, parts)).distinct().collect()):
            own, at = rows.where(part_of(key, parts) == k), f"{path}/part{k}"
            replace_table(latest_row(read_or_empty(spark, at, rows).unionByName(own).distinct(), [key], ts, tie), at)
        release(rows)

    return run


def reconcile(spark: SparkSession, source: DataFrame, path: str, key: str, ts: str, tie: str, parts: int = PARTS) -> None:
    """The daily repair: whatever the stream has missed of ``source`` is upserted; nothing is deleted."""
    upsert_latest(path, key, ts, tie, parts)(source, 0)


def start_mirror(stream: DataFrame, path: str, checkpoint: str, key: str, ts: str, tie: str, parts: int = PARTS):
    """Starts the upsert of a stream into ``path``; runs until what is available has been read."""
    return stream.writeStream.foreachBatch(upsert_latest(path, key, ts, tie, parts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
