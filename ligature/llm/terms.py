"""Occurrences and record counts of every distinct term by last-seen counters.

Tokens are hash-partitioned and ordered by record; while a partition streams by, each term keeps
three numbers only: occurrences, records and the last record it was seen in. A term counts a new
record when the record differs from the last one, so no set of records is ever kept. Terms that
fill a large part of all records are spread: the partition key also holds a bucket of the record
id, every record lies in exactly one bucket, and the buckets' counts are summed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligature.functions.text import is_blank, normal, trimmed

COUNTS = "attr_name string, term string, occurrences long, records long"


def language_tags(col: Column) -> Column:
    """The tags of an accept-language value: lower case, ``_`` as ``-``, weights dropped; none if blank."""
    parts = F.split(F.translate(F.lower(trimmed(col)), "_", "-"), r"""[,;\s \[\](){}<>"'`‘-‟«»]+""")
    tags = F.filter(parts, lambda t: (t != "") & ~t.rlike(r"^q\s*="))
    return F.when(is_blank(col), F.array().cast("array<string>")).otherwise(tags)


def tokens(rows: DataFrame, id_col: str, hashes: list[str], tagged: list[str]) -> DataFrame:
    """``(attr_name, term, id)`` of every occurrence, repeated ones too; rows without id have none."""
    kinds = [F.struct(F.lit(c).alias("attr_name"), F.array_compact(F.array(normal(F.col(c)))).alias("terms")) for c in hashes]
    kinds += [F.struct(F.lit(c).alias("attr_name"), language_tags(F.col(c)).alias("terms")) for c in tagged]
    return rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.explode(F.array(*kinds)).alias("_k")).select(F.col("_k.attr_name").alias("attr_name"), F.explode("_k.terms").alias("term"), "id")


def last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters over batches of ``(attr_name, term, id, n)`` in that order; only the open term is carried between batches."""
    open_term: tuple[str, str] | None = None
    occurrences = records = 0
    last: int | None = None

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["attr_name", "term", "occurrences", "records"])

    for batch in batches:
        if not batch.num_rows:
            continue
        attr, term = (batch.column(k).dictionary_encode() for k in (0, 1))
        ids, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
        key = attr.indices.to_numpy().astype(np.int64) * (len(term.dictionary) + 1) + term.indices.to_numpy()
        new_term = np.append(True, key[1:] != key[:-1])
        new_record = new_term | np.append(True, ids[1:] != ids[:-1])
        starts = np.flatnonzero(new_term)
        occ, rec = np.add.reduceat(n, starts), np.add.reduceat(new_record.astype(np.int64), starts)
        ends = np.append(starts[1:], len(key)) - 1
        done = []
        for s, e, o, r in zip(starts.tolist(), ends.tolist(), occ.tolist(), rec.tolist()):
            this = (attr.dictionary[attr.indices[s].as_py()].as_py(), term.dictionary[term.indices[s].as_py()].as_py())
            if this == open_term:
                occurrences, records = occurrences + o, records + r - (last == ids[s])
            else:
                if open_term is not None:
                    done.append((*open_term, occurrences, records))
                open_term, occurrences, records = this, o, r
            last = ids[e]
        if done:
            yield emit(done)
    if open_term is not None:
        yield emit([(*open_term, occurrences, records)])


def frequencies(toks: DataFrame, total_records: int, bucket_records: int = 100_000) -> DataFrame:
    """One row ``(attr_name, term, occurrences, records)`` per distinct term of ``(attr_name, term, id)``.

    Null terms are not counted; an empty table gives no rows. The tokens are shuffled once; the buckets follow
    from the number of records, so that about ``bucket_records`` records of a term at most meet in one partition.
    """
    buckets = max(64, -(-total_records // bucket_records))
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets).cast("long")).alias("bucket")
    ordered = toks.where("term is not null and id is not null").select("attr_name", "term", bucket, "id", F.lit(1).cast("long").alias("n")).repartition("attr_name", "term", "bucket").sortWithinPartitions("attr_name", "term", "bucket", "id")
    parts = ordered.select("attr_name", "term", "id", "n").mapInArrow(last_seen, COUNTS)
    return parts.groupBy("attr_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marks(counts: DataFrame, total_records: int, rare: int = 1, common_share: float = 0.02) -> DataFrame:
    """``(attr_name, term, occurrences, records, mark)``: ``rare`` up to ``rare`` records, else ``common`` above the share, else null."""
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common_share) * F.lit(total_records), "common")
    return counts.withColumn("mark", mark)
