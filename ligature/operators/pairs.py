"""Pairs of articles that share kept values, their score and their ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ligature.operators.tokens import DECISION, DOC, NET, RANKED

RETRIEVE = 3.0


def bit_of():
    return F.create_map(*(x for a, (bit, _) in RANKED.items() for x in (F.lit(a), F.lit(bit))))[F.col("attr")]


def has(mask: int):
    return F.col("matched").bitwiseAND(F.lit(mask)) > 0


def score():
    """Sum of the matched weights, closeness in time, difference of organisations, and the bonus for network with document."""
    weights = sum((F.when(has(bit), float(w)).otherwise(0.0) for bit, w in RANKED.values()), F.lit(0.0))
    days = F.abs(F.datediff("created_a", "created_b"))
    time = F.when(days <= 7, 1.0).when(days <= 30, 0.5).otherwise(0.0)
    both = (F.col("org_a") != "") & (F.col("org_b") != "") & has(DECISION)
    orgs = F.when(both & (F.col("org_a") != F.col("org_b")), 2.0).when(both & has(NET), -2.0).otherwise(0.0)
    return weights + time + orgs + F.when(has(NET) & has(DOC), 4.0).otherwise(0.0)


def peers_of(index: DataFrame, subjects: DataFrame, k: int = 20, least: float = RETRIEVE) -> DataFrame:
    """The ``k`` best peers of the given subjects among all articles. Only the subjects' tokens are joined; their peers aren't restricted."""
    t = index.where(F.col("attr").isin(*RANKED)).select("attr", "value", "article_id", "created_on", "author_org", bit_of().alias("bit"))
    a = t.join(subjects, "article_id", "left_semi").select("attr", "value", "bit", F.col("article_id").alias("subject"), F.col("created_on").alias("created_a"), F.col("author_org").alias("org_a"))
    b = t.select("attr", "value", F.col("article_id").alias("peer"), F.col("created_on").alias("created_b"), F.col("author_org").alias("org_b"))
    met = a.join(b, ["attr", "value"]).where(F.col("subject") != F.col("peer"))
    merged = met.groupBy("subject", "peer", "created_a", "created_b", "org_a", "org_b").agg(F.bit_or("bit").alias("matched"))
    by = Window.partitionBy("subject").orderBy(F.desc("score"), first_attr(), "peer")
    scored = merged.select("subject", "peer", "matched", score().alias("score")).where(F.col("score") >= least)
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def scored_pairs(index: DataFrame) -> DataFrame:
    """``(a, b, matched, score)``, a < b, of all pairs that share a kept value of a ranked attribute.

    Caps bound every value's pairs before the join. What the score needs travels with the tokens,
    so the pairs are shuffled once, for the union of their bits, and never joined again.
    """
    t = index.where(F.col("attr").isin(*RANKED)).select("attr", "value", "article_id", "created_on", "author_org", bit_of().alias("bit"))
    a = t.select("attr", "value", "bit", F.col("article_id").alias("a"), F.col("created_on").alias("created_a"), F.col("author_org").alias("org_a"))
    b = t.select("attr", "value", F.col("article_id").alias("b"), F.col("created_on").alias("created_b"), F.col("author_org").alias("org_b"))
    met = a.join(b, ["attr", "value"]).where(F.col("a") < F.col("b"))
    merged = met.groupBy("a", "b", "created_a", "created_b", "org_a", "org_b").agg(F.bit_or("bit").alias("matched"))
    return merged.select("a", "b", "matched", score().alias("score"))


def mirrored(pairs: DataFrame) -> DataFrame:
    """``(subject, peer, matched, score)``: each pair from both sides."""
    sides = F.array(F.struct(F.col("a").alias("subject"), F.col("b").alias("peer")), F.struct(F.col("b").alias("subject"), F.col("a").alias("peer")))
    return pairs.select(F.explode(sides).alias("_s"), "matched", "score").select("_s.subject", "_s.peer", "matched", "score")


def first_attr():
    """Rank of the first matched attribute, the tie-break between equal scores."""
    rank = F.lit(len(RANKED))
    for k, (bit, _) in reversed(list(enumerate(RANKED.values()))):
        rank = F.when(has(bit), k).otherwise(rank)
    return rank


def top_peers(pairs: DataFrame, k: int = 20, least: float = RETRIEVE) -> DataFrame:
    """The ``k`` best peers of each subject: by score, first matched attribute, peer."""
    by = Window.partitionBy("subject").orderBy(F.desc("score"), first_attr(), "peer")
    return mirrored(pairs).where(F.col("score") >= least).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def best_peer(pairs: DataFrame) -> DataFrame:
    """``(subject, peer, matched, score)`` of each subject's best peer, by one aggregation."""
    place = F.struct((-F.col("score")).alias("s"), first_attr().alias("f"), F.col("peer").alias("p"))
    best = mirrored(pairs).groupBy("subject").agg(F.min_by(F.struct("peer", "matched", "score"), place).alias("_b"))
    return best.select("subject", "_b.peer", "_b.matched", "_b.score")


def peer_counts(pairs: DataFrame) -> DataFrame:
    """``(article_id, n_peers, max_score, n_all, max_all)``: of peers at or above the retrieval score, and of all."""
    near = F.col("score") >= RETRIEVE
    return mirrored(pairs).groupBy(F.col("subject").alias("article_id")).agg(F.count_if(near).alias("n_peers"), F.coalesce(F.max(F.when(near, F.col("score"))), F.lit(0.0)).alias("max_score"), F.count("*").alias("n_all"), F.max("score").alias("max_all"))
