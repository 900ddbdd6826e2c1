"""Labels of articles by structure: hubs passed, flagged peers, and the matches behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ligature.operators import hubs
from ligature.operators.pairs import bit_of, has, score
from ligature.operators.tokens import CAPS, DECISION, DOC, NET, RANKED, cap_of, frequencies, unpivot

WARN = 34.0


def passing_attrs(passed: DataFrame, full: int = DECISION) -> DataFrame:
    """``(article_id, passed, n_passed, all_four, near, net_doc)`` from the passed hub memberships; ``full`` are the attributes that all_four asks for."""
    bits = passed.groupBy("article_id").agg(F.bit_or(bit_of()).alias("passed"))
    p = F.col("passed")
    return bits.select("article_id", p, F.bit_count(p).alias("n_passed"), (p.bitwiseAND(F.lit(full)) == full).alias("all_four"), (F.bit_count(p) >= 3).alias("near"), ((p.bitwiseAND(F.lit(NET)) > 0) & (p.bitwiseAND(F.lit(DOC)) > 0)).alias("net_doc"))


def flagged_peers(passed: DataFrame, index: DataFrame, flags: DataFrame) -> DataFrame:
    """Subjects with a flagged peer that shares network and document values, one of them in a hub the subject passes.

    Only the tokens of flagged articles are joined, not the pairs of all.
    """
    t = index.where(F.col("attr").isin(*RANKED)).select("attr", "value", "article_id", bit_of().alias("bit"))
    theirs = t.join(flags, "article_id", "left_semi").select("attr", "value", F.col("article_id").alias("peer"))
    met = t.withColumnRenamed("article_id", "subject").join(theirs, ["attr", "value"]).where(F.col("subject") != F.col("peer"))
    near = met.groupBy("subject", "peer").agg(F.bit_or("bit").alias("matched")).where(has(NET) & has(DOC))
    shared = passed.select(F.col("article_id").alias("subject"), "attr", "value").join(theirs, ["attr", "value"]).select("subject", "peer")
    return near.select("subject", "peer").join(shared, ["subject", "peer"], "left_semi").select(F.col("subject").alias("article_id")).distinct()


def alive(index: DataFrame) -> DataFrame:
    """``(article_id, red)`` of the connected articles."""
    return index.select("article_id", (F.col("wd_status") == "red").alias("red")).distinct()


def outcomes(index: DataFrame, counts: DataFrame, flags: DataFrame, warn: float = WARN, most_share: float = 0.5, least: int = 5, least_names: int = 2, full: int = DECISION) -> DataFrame:
    """One row per connected article: outcome, max_score, n_peers and the three reasons as 0 or 1.

    The thresholds are those of :func:`hubs.passing` and :func:`passing_attrs`.
    """
    passed = hubs.passing(index, most_share, least, least_names)
    b1 = flagged_peers(passed, index, flags).withColumn("b1", F.lit(1))
    b0 = passing_attrs(passed, full).select("article_id", F.col("all_four").cast("int").alias("b0"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = alive(index).join(counts.select("article_id", "n_peers", "max_score"), "article_id", "left").join(b0, "article_id", "left").join(b1, "article_id", "left")
    rows = rows.select("article_id", F.coalesce("max_score", F.lit(0.0)).alias("max_score"), F.coalesce("n_peers", F.lit(0)).alias("n_peers"), zero("b0"), zero("b1"), F.col("red").cast("int").alias("b2"))
    outcome = F.when((F.col("b0") + F.col("b1") + F.col("b2")) > 0, "BLOCK").when(F.col("max_score") >= warn, "WARN").otherwise("PASS")
    return rows.withColumn("outcome", outcome)


def flagged_matches(derived: DataFrame, flags: DataFrame, k: int = 15, caps: dict[str, int] = CAPS, shared: tuple[int, int] = (NET, DOC)) -> DataFrame:
    """``(subject, peer, matched, score, rank, match_total)``: flagged peers of any age that share network and document values.

    Values above the cap over the whole corpus are skipped; one holder is enough. Flags are joined
    when the query runs, so a new flag needs no rebuild. ``match_total`` counts all matches, the
    ``k`` best are returned. ``shared`` are the two masks of attributes of which each must be met.
    """
    ranked = tuple(RANKED)
    toks = unpivot(derived, ranked, carry=("created_on", "author_org")).withColumn("bit", bit_of())
    inside = frequencies(toks).where(F.col("df") <= cap_of(caps)).select("attr", "value")
    theirs = toks.join(flags, "article_id", "left_semi").join(inside, ["attr", "value"], "left_semi")
    peers = theirs.select("attr", "value", F.col("article_id").alias("peer"), F.col("created_on").alias("created_b"), F.col("author_org").alias("org_b"))
    mine = toks.select("attr", "value", "bit", F.col("article_id").alias("subject"), F.col("created_on").alias("created_a"), F.col("author_org").alias("org_a"))
    met = mine.join(peers, ["attr", "value"]).where(F.col("subject") != F.col("peer"))
    merged = met.groupBy("subject", "peer", "created_a", "created_b", "org_a", "org_b").agg(F.bit_or("bit").alias("matched")).where(has(shared[0]) & has(shared[1]))
    overlap = F.bit_count(F.col("matched").bitwiseAND(F.lit(DECISION)))
    scored = merged.withColumn("score", score())
    by = Window.partitionBy("subject")
    order = by.orderBy(F.desc("score"), F.desc(overlap), F.desc("created_b"), "peer")
    return scored.withColumn("match_total", F.count("*").over(by)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("subject", "peer", "matched", "score", "rank", "match_total")


def flagged_outcomes(derived: DataFrame, matches: DataFrame) -> DataFrame:
    """``(article_id, match_total, b1, b2, outcome)`` of every article: BLOCK with a flagged match or a red document, else PASS."""
    totals = matches.groupBy(F.col("subject").alias("article_id")).agg(F.max("match_total").alias("match_total"))
    rows = derived.select("article_id", (F.col("wd_status") == "red").cast("int").alias("b2")).distinct().join(totals, "article_id", "left")
    b1 = F.coalesce((F.col("match_total") >= 1).cast("int"), F.lit(0))
    return rows.select("article_id", F.coalesce("match_total", F.lit(0)).alias("match_total"), b1.alias("b1"), "b2", F.when((b1 + F.col("b2")) > 0, "BLOCK").otherwise("PASS").alias("outcome"))


def chips(matches: DataFrame) -> DataFrame:
    """``matches`` with the names of the matched attributes, in their order."""
    names = F.array_compact(F.array(*(F.when(has(bit), F.lit(a)) for a, (bit, _) in RANKED.items())))
    return matches.withColumn("chips", F.array_join(names, "+"))

