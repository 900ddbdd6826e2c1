"""All pairs of set-valued records above a Jaccard threshold, by T-occurrence list merging.

Values are ranked from rare to frequent. Two sets that reach the threshold share at least T values,
so they meet in one of the |x| - T + 1 rarest values of each: only those inverted lists are formed
and partitioned by value; the T - 1 longest lists of a record are never merged, only searched.
Inside a list the records are joined by DivideSkip: short lists of the remaining values are merged
by a heap that skips ahead to the next record that can still reach T, the longest ones are
binary-searched. Values are numbered exactly, once for the whole table, and values of one record only
count for the size of its set but join nothing.

A list longer than ``hot`` is not merged as a whole: since the values are ranked, two sets that
first meet in a hot value share T values that are all hot, hence two of the |x| - T + 2 rarest, and
the list is split by that second value. What is still long is cut into blocks that are joined block
by block, so no list is held by one task and no pair is lost. A pair is emitted only by the list of
its own rarest common value(s), so no shuffle is needed to remove repeats.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligature.functions.text import normal
from ligature.runtime import cut, join_counted, release

PAIRS = "left_id long, right_id long, overlap int"


def value_sets(rows: DataFrame, id_col: str, value_cols: list[str]) -> DataFrame:
    """Distinct ``(id, value)``: each record's non-blank values over all its rows, marked with the number of their column."""
    values = F.array(*(F.concat(F.lit(f"{k}:"), normal(F.col(c))) for k, c in enumerate(value_cols)))
    return rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.explode(values).alias("value")).where("value is not null").distinct()


def needed(a: int, b: int, num: int, den: int) -> int:
    """Smallest overlap with which sets of a and b values reach a Jaccard similarity of num/den (in whole numbers)."""
    return -(-(a + b) * num // (num + den))


def divide_skip(lists: list[list[int]], t: int, long: int) -> Iterator[tuple[int, int]]:
    """``(record, count)`` of the records that occur at least t times in the sorted ``lists``.

    The ``long`` longest lists are only searched; the rest is merged with skipping.
    """
    lists = sorted((x for x in lists if x), key=len)
    if t <= 0 or len(lists) < t:
        return
    long = min(long, t - 1)
    short, rest = (lists[:-long], lists[-long:]) if long else (lists, [])
    least = t - long
    at = [0] * len(short)
    heap = [(x[0], k) for k, x in enumerate(short)]
    heapq.heapify(heap)
    while len(heap) >= least:
        record, popped = heap[0][0], []
        while heap and heap[0][0] == record:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            n = len(popped)
            for x in rest:
                p = bisect_left(x, record)
                n += p < len(x) and x[p] == record
            if n >= t:
                yield record, n
            target = record + 1
        else:  # too few here: the lists in front may skip to the next record that enough lists can hold
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            target = heap[0][0]
        for k in popped:
            at[k] = bisect_left(short[k], target, at[k])
            if at[k] < len(short[k]):
                heapq.heappush(heap, (short[k][at[k]], k))


def merge_list(members: list[tuple[int, int, int, tuple[int, ...]]], key: tuple[int, ...], num: int, den: int) -> Iterator[tuple[int, int, int]]:
    """Similar pairs of one inverted list's ``(id, side, size, values)``; side 0 joins 1, side 2 joins itself and both.

    ``values`` are ranked, ``size`` also counts those that no other record has; a pair counts only if ``key`` are its first common values.
    """
    members.sort(key=lambda m: m[2])
    lists: dict[int, list[int]] = {}
    sets = [frozenset(m[3]) for m in members]
    for k, (own, side, size, values) in enumerate(members):
        # Members so far are no larger, so size * num / den is the least size that can be similar.
        least = needed(-(-size * num // den), size, num, den)
        for j, n in divide_skip([lists[v] for v in values if v in lists], least, max(0, least - 2)):
            other, at, theirs, _ = members[j]
            if other == own or (side == at and side != 2) or n < needed(theirs, size, num, den):
                continue
            if tuple([v for v in values if v in sets[j]][: len(key)]) == key:
                yield (other, own, n) if other < own else (own, other, n)
        for v in values:
            lists.setdefault(v, []).append(k)


def merge(num: int, den: int):
    """A map over batches of ``(k1, k2, cell, id, side, size, values)`` ordered by the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, members = None, []

        def close(out: list) -> None:
            if len(members) > 1:
                k1, k2, _ = open_key
                out.extend(merge_list(members, (k1,) if k2 is None else (k1, k2), num, den))

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32()))], names=["left_id", "right_id", "overlap"])

        out: list = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if row[:3] != open_key:
                    close(out)
                    open_key, members = row[:3], []
                members.append((row[3], row[4], row[5], tuple(row[6])))
                if len(out) > 50_000:
                    yield batch_of(out)
                    out = []
        if open_key is not None:
            close(out)
        if out:
            yield batch_of(out)

    return run


def giant_pairs(clean: DataFrame, sizes: DataFrame, num: int, den: int, large: int) -> DataFrame:
    """Similar pairs of which one set has more than ``large`` values.

    Partners have at least num/den of that size, so there are few sets; their overlaps are counted by
    joining values and partial sums, never in one task.
    """
    near = sizes.where(F.col("n") * den >= F.lit(large) * num)
    own = clean.join(near, "id")
    a, b = own.select("value", F.col("id").alias("left_id"), F.col("n").alias("na")), own.select("value", F.col("id").alias("right_id"), F.col("n").alias("nb"))
    met = a.join(b, "value").where((F.col("left_id") < F.col("right_id")) & (F.greatest("na", "nb") > large) & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num))
    counted = met.groupBy("left_id", "right_id", "na", "nb").agg(F.count("*").cast("int").alias("overlap"))
    return counted.where(F.col("overlap") * (num + den) >= (F.col("na") + F.col("nb")) * num).select("left_id", "right_id", "overlap")


def similar_pairs(sets: DataFrame, num: int = 3, den: int = 5, min_size: int = 4, hot: int = 1000, large: int = 1000) -> DataFrame:
    """``(left_id, right_id, overlap)`` of all pairs with a Jaccard similarity of at least num/den.

    ``sets`` are ``(id, value)`` rows, repeated ones allowed, values of any type that can be grouped; records of
    fewer than ``min_size`` values take no part. left_id is the smaller one. Null ids and values are left out; an
    empty table gives no rows. ``hot`` only decides how a list is split and ``large`` which sets are too
    large to travel with each of their lists, never what is found.
    """
    if needed(min_size, min_size, num, den) < 2 or -(-min_size * num // den) < 2:
        raise ValueError("min_size must be large enough that similar sets share two values")
    clean = cut(sets.where("id is not null and value is not null").select("id", "value").distinct())
    sizes = cut(clean.groupBy("id").agg(F.count("*").cast("int").alias("size")).where(F.col("size") >= min_size))
    # Values of one record join nothing; the others get a number. It is written, so it stays the same.
    shared = cut(clean.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").withColumn("code", F.monotonically_increasing_id()))
    ranked = join_counted(clean, shared, ["value"], clean.count()).select("id", F.col("n").alias("df"), "code")
    # Sets too large to travel are joined value by value; as a rule there is none.
    giants = sizes.where(F.col("size") > large)
    large_pairs = None
    if not giants.isEmpty():
        large_pairs = giant_pairs(ranked.select("id", F.col("code").alias("value")), sizes.withColumnRenamed("size", "n"), num, den, large)
        ranked = ranked.join(giants, "id", "left_anti")
    entry = F.sort_array(F.collect_list(F.struct("df", "code")))
    m = F.size("e")
    t = F.ceil(F.col("size") * num / F.lit(den)).cast("int")  # the least overlap of a set of this size with any other
    sorted_sets = cut(ranked.groupBy("id").agg(entry.alias("e")).join(sizes, "id").where(m >= t).select("id", "size", "e"))
    if large_pairs is None:
        release(clean)
        release(shared)
    records = sorted_sets.select("id", "size", F.transform("e", lambda x: x.code).alias("values"), F.slice("e", F.lit(1), m - t + 1).alias("p1"), F.filter(F.slice("e", F.lit(1), F.least(m - t + 2, m)), lambda x: x.df > hot).alias("hots"))
    # Lists up to ``hot`` are merged whole.
    single = F.transform(F.filter("p1", lambda x: x.df <= hot), lambda x: x.code)
    parts = records.select(F.explode(single).alias("k1"), F.lit(None).cast("long").alias("k2"), F.lit(0).alias("cell"), "id", F.lit(2).alias("side"), "size", "values")
    # Longer ones are split by a second hot value; a list of n records in b blocks: block i meets block j in cell (i, j), i <= j.
    n_hot = records.agg(F.sum(F.size("hots") * (F.size("hots") - 1) / 2)).first()[0] or 0
    if n_hot:
        double = F.flatten(F.transform("hots", lambda x, i: F.transform(F.slice("hots", i + 2, F.greatest(F.size("hots") - i - 1, F.lit(0))), lambda y: F.struct(x.code.alias("k1"), y.code.alias("k2")))))
        heavy = records.select("id", "size", "values", F.explode(double).alias("_k")).select("id", "size", "values", "_k.*")
        counts = heavy.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1")
        b = F.ceil(F.col("n") / F.lit(hot)).cast("int")
        own = F.pmod(F.xxhash64("id"), F.col("b").cast("long")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda j: F.struct((F.least("own", j) * F.col("b") + F.greatest("own", j)).alias("cell"), F.when(j == F.col("own"), 2).when(F.col("own") < j, 0).otherwise(1).alias("side")))
        split = join_counted(heavy, counts, ["k1", "k2"], int(n_hot)).withColumn("b", b).withColumn("own", own)
        parts = parts.unionByName(split.select("k1", "k2", F.explode(cells).alias("_c"), "id", "size", "values").select("k1", "k2", "_c.cell", "id", "_c.side", "size", "values"))
    found = parts.repartition("k1", "k2", "cell").sortWithinPartitions("k1", "k2", "cell").mapInArrow(merge(num, den), PAIRS)
    return found if large_pairs is None else found.unionByName(large_pairs)
