"""Statistics of tokens, hubs, pairs and labels: one pass each, one row per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ligature.operators.tokens import CAPS, RANKED, cap_of

THRESHOLDS = tuple(range(6, 37, 2))


def half_up(col, digits: int) -> Column:
    """Rounded with ties away from zero for values that aren't negative, by one multiplication and one floor: the same on any engine."""
    col = F.col(col) if isinstance(col, str) else col
    scale = float(10**digits)
    return F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def percentiles(col: str, points: tuple[int, ...], digits: int = 6) -> list[Column]:
    """``p10``-style columns by linear interpolation."""
    return [half_up(F.percentile(F.col(col), F.lit(p / 100)), digits).alias(f"p{p}") for p in points]


def df_stats(frequencies: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """Distribution of document frequencies per attribute, with what lies above the cap. Sums are of one row per value."""
    f = frequencies.withColumn("cap", cap_of(caps))
    over = F.col("df") > F.col("cap")
    total = F.sum("df")
    return f.groupBy("attr", "cap").agg(
        F.count("*").alias("n_values"), total.alias("n_articles"), *percentiles("df", (50, 90, 95, 99)), F.max("df").alias("size_max"),
        F.count_if(over).alias("values_over_cap"), F.sum(F.when(over, F.col("df")).otherwise(0)).alias("mass_over_cap"),
        half_up(F.sum(F.when(over, F.col("df")).otherwise(0)) / total, 4).alias("pct_over_cap"), F.count_if(F.col("df") == 1).alias("singletons"),
        F.count_if((F.col("df") >= 2) & ~over).alias("values_2_to_cap"), F.count_if((F.col("df") >= 5) & ~over).alias("values_5_to_cap"),
    )


def top_sizes(frequencies: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` largest frequencies per attribute, ties by value."""
    by = Window.partitionBy("attr").orderBy(F.desc("df"), "value")
    return frequencies.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("attr", "rank", "value", "df")


def bucket_sizes(hub_stats: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """Sizes of kept values per ranked attribute, and the part of them near the cap."""
    h = hub_stats.where(F.col("attr").isin(*RANKED)).withColumn("cap", cap_of(caps))
    near = (F.col("size") >= F.col("cap") * 0.8).cast("int")
    return h.groupBy("attr", "cap").agg(F.count("*").alias("buckets"), *percentiles("size", (50, 90, 99)), F.max("size").alias("size_max"), half_up(F.avg(near), 4).alias("pct_near_cap"))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Number, percentiles and mean of the pair scores."""
    return pairs.agg(F.count("*").alias("n_pairs"), *percentiles("score", (10, 25, 50, 75, 90, 95, 99), 2), half_up(F.avg("score"), 2).alias("mean"))


def pattern() -> Column:
    """Names of the matched attributes in alphabetical order, joined by ``+``."""
    names = sorted(RANKED.items())
    return F.concat_ws("+", *(F.when(F.col("matched").bitwiseAND(F.lit(bit)) > 0, F.lit(a)) for a, (bit, _) in names))


def attr_marginals(pairs: DataFrame) -> DataFrame:
    """Pairs that share each ranked attribute: conditional sums of one pass, turned into rows."""
    counts = [F.struct(F.lit(a).alias("attr"), F.count_if(F.col("matched").bitwiseAND(F.lit(bit)) > 0).alias("n_pairs")) for a, (bit, _) in RANKED.items()]
    return pairs.agg(F.array(*counts).alias("_c")).select(F.inline("_c"))


def sample(articles: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` articles without replacement: those with the smallest hashes of seed and id, the same on every run."""
    return articles.select("article_id").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("article_id").cast("string"))), "article_id").limit(n)


def patterns(pairs: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` commonest patterns with mean, median and the score if all agree. Grouped by the bits, named at the end."""
    g = pairs.groupBy("matched").agg(F.count("*").alias("n_pairs"), half_up(F.avg("score"), 2).alias("score_mean"), half_up(F.percentile("score", F.lit(0.5)), 2).alias("score_p50"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    named = g.select(pattern().alias("pattern"), "n_pairs", "score_mean", "score_p50", F.when(half_up("lo", 2) == half_up("hi", 2), half_up("lo", 2)).alias("score_fixed"))
    return named.orderBy(F.desc("n_pairs"), "pattern").limit(k)


def labelled(alive: DataFrame, counts: DataFrame, passed: DataFrame) -> DataFrame:
    """``(article_id, max_all, n_all, b0, near, net_doc, structural, red, any_hub)`` of every connected article."""
    no = lambda c: F.coalesce(c, F.lit(False))
    rows = alive.join(counts.select("article_id", "max_all", "n_all"), "article_id", "left").join(passed, "article_id", "left")
    return rows.select(
        "article_id", F.coalesce("max_all", F.lit(0.0)).alias("max_all"), F.coalesce("n_all", F.lit(0)).alias("n_all"), no("all_four").alias("b0"), no("near").alias("near"), no("net_doc").alias("net_doc"),
        (no("near") | no("net_doc")).alias("structural"), F.col("red"), (F.coalesce("n_passed", F.lit(0)) >= 1).alias("any_hub"),
    )


GROUPS = {
    "all": lambda: F.lit(True),
    "b0": lambda: F.col("b0"),
    "near_not_b0": lambda: F.col("near") & ~F.col("b0"),
    "net_doc_not_b0": lambda: F.col("net_doc") & ~F.col("b0"),
    "structural_not_b0": lambda: F.col("structural") & ~F.col("b0"),
    "any_hub_only": lambda: F.col("any_hub") & ~F.col("structural") & ~F.col("b0"),
    "no_hub": lambda: ~F.col("any_hub"),
    "red": lambda: F.col("red"),
}


def scores_by_label(labels: DataFrame) -> DataFrame:
    """Distribution of the largest score in eight overlapping groups."""
    member = F.array_compact(F.array(*(F.when(cond(), F.lit(name)) for name, cond in GROUPS.items())))
    rows = labels.select(F.explode(member).alias("label"), "max_all")
    return rows.groupBy("label").agg(F.count("*").alias("n"), *percentiles("max_all", (10, 25, 50, 75, 90, 95), 2), half_up(F.avg("max_all"), 2).alias("mean"))


def prevalence(labels: DataFrame) -> DataFrame:
    """Share of articles with each label."""
    return labels.agg(*(half_up(F.avg(F.col(c).cast("int")), 4).alias(c) for c in ("b0", "near", "net_doc", "structural", "red", "any_hub")))


def sweep(labels: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Rate, recall and precision at every threshold: conditional sums of a single pass, turned into rows."""
    n = lambda cond: F.sum(cond.cast("int"))
    ratio = lambda a, b: half_up(F.try_divide(a, b), 4)
    rows = []
    for t in thresholds:
        hit = F.col("max_all") >= t
        rows.append(
            F.struct(
                F.lit(t).alias("threshold"), ratio(n(hit), F.count("*")).alias("rate"), ratio(n(hit & ~(F.col("b0") | F.col("red"))), F.count("*")).alias("warn_rate"),
                ratio(n(hit & F.col("structural")), n(F.col("structural"))).alias("recall_structural"), ratio(n(hit & F.col("structural")), n(hit)).alias("precision_structural"),
                ratio(n(hit & F.col("b0")), n(F.col("b0"))).alias("recall_b0"), ratio(n(hit & F.col("red")), n(F.col("red"))).alias("recall_red"),
                half_up(F.avg(F.when(hit, F.col("n_all"))), 1).alias("mean_peers"),
            )
        )
    return labels.agg(F.array(*rows).alias("_r")).select(F.inline("_r"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The most precise threshold that marks 3 to 12 % beside those marked anyway, with a precision of 0.4 or more; else the one nearest 7 %."""
    good = F.col("warn_rate").between(0.03, 0.12) & (F.coalesce("precision_structural", F.lit(0.0)) >= 0.4)
    order = [F.desc(good), F.when(good, -F.col("precision_structural")), F.when(good, half_up(F.abs(F.col("warn_rate") - 0.06), 6)).otherwise(half_up(F.abs(F.col("warn_rate") - 0.07), 6)), F.col("threshold")]
    return swept.orderBy(*order).limit(1)


def lift(labels: DataFrame, best: DataFrame) -> DataFrame:
    """Per ranked attribute: how often articles whose best peer shares it carry a structural label, against all articles."""
    positive = (F.col("structural") | F.col("b0")).cast("int")
    base = labels.agg(F.avg(positive)).first()[0]
    attrs = F.array_compact(F.array(*(F.when(F.col("matched").bitwiseAND(F.lit(bit)) > 0, F.lit(a)) for a, (bit, _) in RANKED.items())))
    rows = best.select(F.col("subject").alias("article_id"), F.explode(attrs).alias("attr")).join(labels.select("article_id", positive.alias("y")), "article_id")
    weight = F.create_map(*(x for a, (_, w) in RANKED.items() for x in (F.lit(a), F.lit(w))))[F.col("attr")]
    base_col = F.lit(base).cast("double")
    return rows.groupBy("attr").agg(F.count("*").alias("n"), F.avg("y").alias("r")).select("attr", "n", half_up("r", 4).alias("rate"), half_up(base_col, 4).alias("baseline"), half_up(F.try_divide(F.col("r"), base_col), 3).alias("lift"), weight.alias("weight"))


def lift_order(lifts: DataFrame, least: int = 100) -> DataFrame:
    """``(place, attr, lift, weight)``: attributes seen with at least ``least`` articles, by falling lift, then name."""
    return lifts.where(F.col("n") >= least).select(F.row_number().over(Window.orderBy(F.desc(F.coalesce("lift", F.lit(0.0))), "attr")).alias("place"), "attr", "lift", "weight")


def feature_scores(spark) -> DataFrame:
    """``(attr, score)``: what a match of one attribute alone is worth, without boosts."""
    return spark.createDataFrame([(a, float(w)) for a, (_, w) in RANKED.items()], "attr string, score double")


def coverage(articles: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows, and rows with each column filled."""
    return articles.agg(F.count("*").alias("n_rows"), *(F.count_if(F.coalesce(F.trim(c), F.lit("")) != "").alias(f"n_{c}") for c in columns))
