"""Runs of close events per key by dense accumulator arrays, without giving any key to a single task.

Time is cut into blocks of slots; a slot is as wide as the largest allowed gap, so all rows of a key
in one slot belong to one run. Rows go to equal splits of whole blocks; a block that holds more than a
split's rows is dealt out over several. In a split the (key, block) pairs are dictionary-encoded and its
rows are scattered with numpy into dense arrays (pair x slot) that hold count, first and last event. Where a
split holds all of a block, the runs inside are read off the arrays at once; of a block that was dealt
out, the non-empty cells of all its arrays are summed by a distributed reduction first. Only runs that
touch the edge of their block are chained across blocks, at most two per key and block; all others
are final where they are found, so a key with most of the rows is nobody's work alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ligature.functions.text import normal
from ligature.runtime import cut, hot_limit

#: Rows that are reduced together; a block with more is dealt out.
SPLIT_ROWS = 200_000
#: Cells of one dense array; more pairs are taken in turns.
ARRAY_CELLS = 2_000_000
CELLS = "attr_name string, key_value string, block long, slot long, n long, first_us long, first_id long, last_us long"
NO_TIME, NO_ID = np.iinfo(np.int64).max, np.iinfo(np.int64).max


def accumulate(pair: np.ndarray, slot: np.ndarray, t: np.ndarray, own: np.ndarray, n_pairs: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(pair, slot, n, first, first id, last)`` of the non-empty cells, ordered by pair and slot, from dense arrays (pair x slot)."""
    step = max(1, ARRAY_CELLS // width)
    order = None if n_pairs <= step else np.argsort(pair, kind="stable")
    bounds = None if order is None else np.searchsorted(pair[order], np.arange(0, n_pairs + step, step))
    for k, low in enumerate(range(0, n_pairs, step)):
        rows = slice(None) if order is None else order[bounds[k] : bounds[k + 1]]
        size = (min(low + step, n_pairs) - low) * width
        cell, ts, ids = (pair[rows] - low) * width + slot[rows], t[rows], own[rows]
        count = np.bincount(cell, minlength=size)
        first, last, first_id = np.full(size, NO_TIME), np.full(size, -NO_TIME), np.full(size, NO_ID)
        np.minimum.at(first, cell, ts)
        np.maximum.at(last, cell, ts)
        at_first = ts == first[cell]
        np.minimum.at(first_id, cell[at_first], ids[at_first])
        full = np.flatnonzero(count)
        yield full // width + low, full % width, count[full], first[full], first_id[full], last[full]


def scatter(attrs: tuple[str, ...], gap_us: int, block_slots: int, min_rows: int, split_rows: int = SPLIT_ROWS):
    """A map over Arrow batches of ``block, parts, id, ts_us, <attrs>`` ordered by block and part.

    Emits the runs of whole blocks that are long enough or touch an edge, and the cells of blocks that were dealt out.
    """
    block_us = gap_us * block_slots

    def one(attr: str, table: dict[str, np.ndarray], values: pa.Array) -> Iterator[pa.RecordBatch]:
        coded = values.dictionary_encode()
        there = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
        if not len(there):
            return
        codes = coded.indices.take(pa.array(there)).to_numpy().astype(np.int64)
        block, t, own, whole = (table[c][there] for c in ("block", "ts", "id", "whole"))
        low = block.min()
        span = int(block.max() - low) + 1
        pairs = pa.array(codes * span + (block - low)).dictionary_encode()
        key_of = pairs.dictionary.to_numpy()
        complete = np.zeros(len(key_of), bool)
        pair = pairs.indices.to_numpy().astype(np.int64)
        complete[pair] = whole
        for p, slot, n, first, first_id, last in accumulate(pair, t // gap_us - block * block_slots, t, own, len(key_of), block_slots):
            # A cell begins a run if its pair was dealt out, or it is too far from the cell before.
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1]) | (first[1:] - last[:-1] > gap_us) | ~complete[p[1:]]
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(p)) - 1
            total, p, slot, first, first_id, last = np.add.reduceat(n, starts), p[starts], slot[starts], first[starts], first_id[starts], last[ends]
            at = key_of[p] % span + low
            edge = (first - at * block_us <= gap_us) | ((at + 1) * block_us - last <= gap_us)
            keep = np.flatnonzero(edge | (total >= min_rows) | ~complete[p])
            at, p = at[keep], p[keep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([attr] * len(keep), pa.string()),
                    pc.cast(coded.dictionary.take(pa.array(key_of[p] // span)), pa.string()),
                    pa.array(at), pa.array(at * block_slots + slot[keep]), pa.array(total[keep].astype(np.int64)), pa.array(first[keep]), pa.array(first_id[keep]), pa.array(last[keep]),
                ],
                names=[f.split()[0] for f in CELLS.split(", ")],
            )

    def reduced(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = {"block": table.column("block").to_numpy(), "id": table.column("id").to_numpy(), "ts": table.column("ts_us").to_numpy(), "whole": table.column("parts").to_numpy() == 1}
        for attr in attrs:
            values = table.column(attr).combine_chunks()
            yield from one(attr, columns, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < split_rows:
                continue
            # All but the last block are complete; a dealt-out block need not be.
            table = pa.Table.from_batches(held)
            blocks, parts = table.column("block").to_numpy(), table.column("parts").to_numpy()
            end = rows if parts[-1] > 1 else int(np.searchsorted(blocks, blocks[-1]))
            if end:
                yield from reduced(table.slice(0, end))
                held = table.slice(end).to_batches()
                rows -= end
        if rows:
            yield from reduced(pa.Table.from_batches(held))

    return run


def micros(ts):
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    at = ts.cast("timestamp_ntz")
    seconds = F.date_diff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(at) * 3600 + F.minute(at) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def bursts(
    rows: DataFrame,
    attrs: tuple[str, ...],
    id_col: str = "id",
    ts_col: str = "last_enrich_utc",
    gap_seconds: int = 600,
    min_rows: int = 4,
    block_slots: int = 36,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """One row ``(attr_name, key_value, first_id, n, first_us, last_us)`` per run of ``min_rows`` or more.

    A run is a longest sequence of one key's rows, ordered by time and then id, in which each row
    comes at most ``gap_seconds`` after the one before. Rows without id or time, and blank keys,
    take no part. Rows that repeat an id count once; if they differ, the one that is smallest by
    (time, keys) stays. Ties in time are broken by id. An empty table gives no rows. Other columns
    are ignored, whatever their names. ``block_slots`` and ``split_rows`` decide how the work is split,
    never what is found.
    """
    gap_us = gap_seconds * 1_000_000
    block_us = gap_us * block_slots
    timed = rows.where(F.col(id_col).isNotNull() & F.col(ts_col).isNotNull())
    block = F.floor(F.col("ts_us") / F.lit(float(block_us))).cast("long")
    # Blocks with more rows than a split: how many splits each is dealt out over. The sum of n is the number of rows, so few blocks are above the limit.
    sizes = cut(timed.select(micros(F.col(ts_col)).alias("ts_us")).groupBy(block.alias("block")).agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = F.broadcast(sizes.where(F.col("n") > hot_limit(total, split_rows)).select("block", F.ceil(F.col("n") / split_rows).cast("int").alias("parts")))
    once = (
        timed.select(F.col(id_col).cast("long").alias("id"), F.struct(micros(F.col(ts_col)).alias("ts_us"), *(normal(F.col(a)).alias(a) for a in attrs)).alias("_row"))
        .groupBy("id")
        .agg(F.min("_row").alias("_row"))
        .select("id", "_row.*")
    )
    dealt = once.withColumn("block", block).join(large, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")))
    splits = dealt.repartition("block", "part").sortWithinPartitions("block", "part")
    cells = (
        splits.select("block", "parts", "id", "ts_us", *attrs)
        .mapInArrow(scatter(attrs, gap_us, block_slots, min_rows, split_rows), CELLS)
        .groupBy("attr_name", "key_value", "block", "slot")
        .agg(F.sum("n").alias("n"), F.min(F.struct("first_us", "first_id")).alias("_first"), F.max("last_us").alias("last_us"))
        .select("attr_name", "key_value", "block", "slot", "n", "_first.first_us", "_first.first_id", "last_us")
    )

    def chained(df: DataFrame, keys: list[str]) -> DataFrame:
        by = Window.partitionBy(*keys).orderBy("first_us", "first_id")
        new = F.coalesce((F.col("first_us") - F.lag("last_us").over(by) > gap_us).cast("int"), F.lit(1))
        return (
            df.withColumn("_new", new)
            .withColumn("_run", F.sum("_new").over(by))
            .groupBy(*keys, "_run")
            .agg(F.sum("n").alias("n"), F.min(F.struct("first_us", "first_id")).alias("_first"), F.max("last_us").alias("last_us"))
            .select(*keys, "n", "_first.first_us", "_first.first_id", "last_us")
        )

    runs = chained(cells, ["attr_name", "key_value", "block"])
    edge = (F.col("first_us") - F.col("block") * block_us <= gap_us) | ((F.col("block") + 1) * block_us - F.col("last_us") <= gap_us)
    # A run inside its block is final: it stays with its block. The runs at edges, at most two per block, meet by key.
    runs = runs.where(edge | (F.col("n") >= min_rows)).withColumn("lane", F.when(~edge, F.col("block")))
    return chained(runs, ["attr_name", "key_value", "lane"]).where(F.col("n") >= min_rows).select("attr_name", "key_value", "first_id", "n", "first_us", "last_us")
