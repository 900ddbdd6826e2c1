"""Hubs: the articles that share a kept value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligature.operators.tokens import CAPS, RANKED, cap_of

DECISION_ATTRS = tuple(a for a, (bit, _) in RANKED.items() if bit & 15)


def stats(index: DataFrame) -> DataFrame:
    """``(attr, value, size, n_authors, n_orgs)``: distinct names that aren't empty. The cap bounds each group, so sets are safe and one shuffle is enough."""
    named = lambda c: F.size(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    return index.groupBy("attr", "value").agg(F.count("*").alias("size"), named("author_name").cast("bigint").alias("n_authors"), named("author_org").cast("bigint").alias("n_orgs"))


def eligible(hubs: DataFrame, least: int = 5, caps: dict[str, int] = CAPS, least_names: int = 2) -> DataFrame:
    """Decision hubs of enough articles, not above the cap, with enough authors and organisations."""
    return hubs.where(F.col("attr").isin(*DECISION_ATTRS) & (F.col("size") >= least) & (F.col("size") <= cap_of(caps)) & (F.col("n_authors") >= least_names) & (F.col("n_orgs") >= least_names))


def author_share(index: DataFrame) -> DataFrame:
    """``(attr, value, author_name, n, share)``: part of the hub's articles under that name; size counts empty names too."""
    own = index.groupBy("attr", "value", "size", "author_name").agg(F.count("*").alias("n"))
    return own.where("author_name <> ''").select("attr", "value", "author_name", "n", (F.col("n") / F.col("size")).alias("share"))


def passing(index: DataFrame, most_share: float = 0.5, least: int = 5, least_names: int = 2) -> DataFrame:
    """``(article_id, attr, value)``: memberships in eligible hubs that the article's own author doesn't dominate.

    All three inputs are grouped by (attr, value), so one partitioning serves them.
    """
    members = index.where(F.col("attr").isin(*DECISION_ATTRS)).join(eligible(stats(index), least, least_names=least_names).select("attr", "value"), ["attr", "value"])
    share = author_share(index).select("attr", "value", "author_name", "share")
    return members.join(share, ["attr", "value", "author_name"], "left").where(F.coalesce("share", F.lit(0.0)) <= most_share).select("article_id", "attr", "value")


def adjacency(index: DataFrame, attrs: tuple[str, ...] = DECISION_ATTRS) -> DataFrame:
    """``(attr_a, value_a, attr_b, value_b, shared)``: hubs linked by the articles they share. An article holds one value per attribute, so the join is bounded."""
    h = index.where(F.col("attr").isin(*attrs)).select("article_id", "attr", "value")
    a, b = h.select("article_id", F.col("attr").alias("attr_a"), F.col("value").alias("value_a")), h.select("article_id", F.col("attr").alias("attr_b"), F.col("value").alias("value_b"))
    before = (F.col("attr_a") < F.col("attr_b")) | ((F.col("attr_a") == F.col("attr_b")) & (F.col("value_a") < F.col("value_b")))
    return a.join(b, "article_id").where(before).groupBy("attr_a", "value_a", "attr_b", "value_b").agg(F.count("*").alias("shared"))


def neighbours(edges: DataFrame, attr: str, value: str) -> DataFrame:
    """``(attr, value, shared)``: the other ends of the edges at one hub."""
    first = (F.col("attr_a") == attr) & (F.col("value_a") == value)
    second = (F.col("attr_b") == attr) & (F.col("value_b") == value)
    return edges.where(first | second).select(F.when(first, F.col("attr_b")).otherwise(F.col("attr_a")).alias("attr"), F.when(first, F.col("value_b")).otherwise(F.col("value_a")).alias("value"), "shared")


def drilldown(index: DataFrame, attr: str, value: str) -> DataFrame:
    """``(article_id, attr, value)`` of all hubs of the articles in one hub."""
    papers = index.where((F.col("attr") == attr) & (F.col("value") == value)).select("article_id")
    return index.join(papers, "article_id", "left_semi").select("article_id", "attr", "value")


def filtered(index: DataFrame, articles: DataFrame | None = None, attrs: tuple[str, ...] | None = None, different_authors: bool = False, different_orgs: bool = False) -> DataFrame:
    """Hubs of the chosen attributes over the chosen articles, if wanted only those of two authors or organisations; of two articles at least."""
    own = index if articles is None else index.join(articles.select("article_id").distinct(), "article_id", "left_semi")
    h = stats(own if attrs is None else own.where(F.col("attr").isin(*attrs))).where(F.col("size") >= 2)
    h = h.where(F.col("n_authors") >= 2) if different_authors else h
    return h.where(F.col("n_orgs") >= 2) if different_orgs else h


def compare(derived: DataFrame, articles: DataFrame) -> DataFrame:
    """``(article_id, attr, value, shared)``: the tokens of chosen articles, marked where another of them has the same."""
    from pyspark.sql import Window

    from ligature.operators.tokens import unpivot

    own = unpivot(derived.join(articles, "article_id", "left_semi"))
    return own.withColumn("shared", F.count("*").over(Window.partitionBy("attr", "value")) > 1)
