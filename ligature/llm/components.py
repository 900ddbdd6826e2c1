"""Connected groups over pairwise matches by hash-to-min.

Matches come as a bipartite relation (record, value): records that hold the same value match.
Each value is turned into a star around its smallest record, so a value held by a third of all
records adds one edge per record and never a pair of records. Hash-to-min then keeps a cluster
set per vertex as rows ``(v, u)``: every vertex sends its set to the set's minimum, and the
minimum to all others, until nothing changes. Sets are rows, never arrays. Minima are partial
aggregations; the rows of a value or vertex that has very many (the minimum of a giant component
holds all of it) are not gathered for the join but get their minimum where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligature.functions.text import normal
from ligature.runtime import cut, join_counted, release


def value_links(rows: DataFrame, id_col: str, value_cols: list[str], excluded: DataFrame | None = None) -> DataFrame:
    """Distinct ``(attr_name, attr_value, id)`` of the non-blank values, without those in ``excluded``.

    Null ids give no rows. ``excluded`` has attr_name and attr_value and is compared after the same
    normalisation; its null and blank values exclude nothing.
    """
    pairs = F.array(*(F.struct(F.lit(c).alias("attr_name"), normal(F.col(c)).alias("attr_value")) for c in value_cols))
    links = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.explode(pairs).alias("_p")).select("_p.*", "id").where(F.col("attr_value").isNotNull()).distinct()
    if excluded is None:
        return links
    gone = excluded.select(F.trim("attr_name").alias("attr_name"), normal(F.col("attr_value")).alias("attr_value")).where(F.col("attr_value").isNotNull()).distinct()
    return links.join(gone, ["attr_name", "attr_value"], "left_anti")


def stars(links: DataFrame, total: int, least: int = 100_000) -> DataFrame:
    """Edges ``(a, b)``, a > b, from each record to the smallest record with the same value. ``total`` is at least the number of links."""
    heads = links.groupBy("attr_name", "attr_value").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1")
    return join_counted(links, heads, ["attr_name", "attr_value"], total, least).where(F.col("id") > F.col("b")).select(F.col("id").alias("a"), "b").distinct()


def sent(state: DataFrame, total: int, least: int = 100_000) -> DataFrame:
    """One round: the set of each vertex to its minimum, the minimum to the set. ``total`` is the number of rows of ``state``."""
    minima = state.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
    edge = lambda v, u: F.struct(F.col(v).alias("v"), F.col(u).alias("u"))
    return join_counted(state, minima, ["v"], total, least).select(F.explode(F.array(edge("m", "u"), edge("u", "m"))).alias("_e")).select("_e.*").distinct()


def hash_to_min(edges: DataFrame, max_rounds: int = 60, least: int = 100_000) -> DataFrame:
    """One row ``(id, group_id)`` per vertex of ``edges(a, b)``; group_id is the component's smallest id.

    Null ends and self-edges link nothing, repeated and reversed edges count once, an empty table
    gives no rows. Each round is written to the shared checkpoint folder, which bounds the lineage
    and survives lost executors; the round before is then deleted. Rounds grow with the logarithm of the
    longest chain; more than ``max_rounds`` raises an error instead of returning unfinished groups.
    ``least`` is the number of rows from which a vertex may be dealt out.
    """
    edge = lambda v, u: F.struct(F.col(v).alias("v"), F.col(u).alias("u"))
    state = cut(edges.where("a is not null and b is not null and a <> b").select(F.explode(F.array(edge("a", "b"), edge("b", "a"), edge("a", "a"), edge("b", "b"))).alias("_e")).select("_e.*").distinct())
    seen = fingerprint(state)
    for _ in range(max_rounds):
        after = cut(sent(state, seen[0], least))
        release(state)
        state, now = after, fingerprint(after)
        if now == seen:
            return state.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("group_id"))
        seen = now
    raise RuntimeError(f"components not stable after {max_rounds} rounds")


def fingerprint(state: DataFrame) -> tuple[int, int, int]:
    """Count and two order-free hash sums of the state: three numbers, whatever its size."""
    h = F.xxhash64("v", "u")
    row = state.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first()
    return row[0], row[1] or 0, row[2] or 0


def groups(rows: DataFrame, id_col: str, value_cols: list[str], excluded: DataFrame | None = None) -> DataFrame:
    """``(id, group_id)`` of every record that shares a value with another, directly or through others."""
    return hash_to_min(stars(value_links(rows, id_col, value_cols, excluded), rows.count() * len(value_cols)))
