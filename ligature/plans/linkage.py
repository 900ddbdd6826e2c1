"""Queries of the shared-attribute analysis over articles_raw and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligature.functions import messages
from ligature.functions.similarity import email_similarity
from ligature.operators import evaluate, hubs, pairs, report, tokens
from ligature.plans import sql
from ligature.runtime import cut, read, stored


#: Thresholds under which every branch of the evaluation occurs in the test data.
SENSITIVE = {"warn": 12.0, "most_share": 1.0, "least": 2, "least_names": 1, "full": 6}
#: Wider caps, and a pair of attributes of which one is enough.
WIDE_CAPS = {a: 10 * c for a, c in tokens.CAPS.items()}
WIDE = (3, 63)


def _derived(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return tokens.derive(read(spark, d, "articles_raw"), keep=keep)


def _index(spark: SparkSession, d: str) -> DataFrame:
    """The searchable index of a table of articles, built once and kept as long as the table stays as it is."""
    return stored(spark, "index", [f"{d}/articles_raw.parquet"], lambda: tokens.index(_derived(spark, d, *tokens.INDEXED)).repartition("attr", "value"))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return tokens.small_flags(read(spark, d, "flags"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return report.labelled(evaluate.alive(index), pairs.peer_counts(pairs.scored_pairs(index)), evaluate.passing_attrs(hubs.passing(index)))


def derived_articles(spark, d):
    """Every display, score and token column of an article."""
    return _derived(spark, d)


def token_unpivot(spark, d):
    """Tokens before any filter on frequency."""
    return tokens.unpivot(_derived(spark, d, "article_id", *tokens.CAPS))


def token_df(spark, d):
    """Articles per token."""
    return tokens.frequencies(token_unpivot(spark, d))


def token_df_stats(spark, d):
    """Distribution of frequencies per attribute against its cap."""
    return report.df_stats(token_df(spark, d))


def token_top_sizes(spark, d):
    """Five commonest values per attribute."""
    return report.top_sizes(token_df(spark, d))


def kept_buckets(spark, d):
    """Values shared by two articles up to the cap."""
    return tokens.kept(token_unpivot(spark, d)).select("attr", "value", "df").distinct()


def connected_articles(spark, d):
    """Articles that share a strong value."""
    return tokens.connected(tokens.kept(token_unpivot(spark, d)))


def hub_stats(spark, d):
    """Size, authors and organisations of every hub."""
    return hubs.stats(_index(spark, d))


def hub_eligible(spark, d):
    """Hubs that count for decisions."""
    return hubs.eligible(hub_stats(spark, d))


def hub_author_share(spark, d):
    """Share of each author in each hub."""
    return hubs.author_share(_index(spark, d)).select("attr", "value", "author_name", "n", report.half_up("share", 6).alias("share"))


def hub_adjacency(spark, d):
    """Decision hubs linked by shared articles."""
    return hubs.adjacency(_index(spark, d))


def hub_drilldown(spark, d):
    """All hubs around the articles of the largest eligible hub."""
    index = _index(spark, d)
    top = hubs.stats(index).where("attr = 'ip'").orderBy(F.desc("size"), "value").select("value").first()
    return hubs.drilldown(index, "ip", top[0] if top else "")


def compare_shared(spark, d):
    """Tokens of the flagged articles, marked where two of them share one."""
    return hubs.compare(_derived(spark, d, "article_id", *tokens.CAPS), _flags(spark, d))


def pair_bitmask(spark, d):
    """Pairs with the bits of the values they share."""
    return pairs.scored_pairs(_index(spark, d)).select("a", "b", "matched")


def pair_scores(spark, d):
    """Pairs with their score."""
    return pairs.scored_pairs(_index(spark, d))


def pair_score_summary(spark, d):
    """Percentiles of the pair scores."""
    return report.pair_summary(pair_scores(spark, d))


def peer_topk(spark, d):
    """Twenty best peers of every article."""
    return pairs.top_peers(pair_scores(spark, d), 20)


def best_peer(spark, d):
    """The best peer of every article."""
    return pairs.best_peer(pair_scores(spark, d))


def peer_counts(spark, d):
    """Peers and largest score, above the retrieval score and overall."""
    return pairs.peer_counts(pair_scores(spark, d))


def passing_attrs(spark, d):
    """Attributes whose hubs an article passes."""
    return evaluate.passing_attrs(hubs.passing(_index(spark, d)))


def outcomes_legacy(spark, d):
    """Outcome and reasons of every connected article."""
    index = _index(spark, d)
    return evaluate.outcomes(index, pairs.peer_counts(pairs.scored_pairs(index)), _flags(spark, d))


def outcome_rates(spark, d):
    """Articles per outcome and reason."""
    o = outcomes_legacy(spark, d)
    return o.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("b0").alias("n_b0"), F.sum("b1").alias("n_b1"), F.sum("b2").alias("n_b2"))


def flagged_matches(spark, d):
    """Best flagged matches of every article, with the number of all of them and their attributes."""
    return evaluate.chips(evaluate.flagged_matches(_derived(spark, d, *tokens.INDEXED), _flags(spark, d)))


def _red(spark: SparkSession, d: str) -> DataFrame:
    """Articles with a red document, taken as flagged: they share more with others than the few flags do."""
    return _derived(spark, d, "article_id", "wd_status").where("wd_status = 'red'").select("article_id")


def red_matches(spark, d):
    """Matches with articles of red documents, ranked, with the number of all of them and their attributes."""
    return evaluate.chips(evaluate.flagged_matches(_derived(spark, d, *tokens.INDEXED), _red(spark, d), k=1, caps=WIDE_CAPS, shared=WIDE))


def flagged_outcomes(spark, d):
    """BLOCK by a flagged match or a red document, else PASS, with the flags of the flag table."""
    derived = _derived(spark, d, *tokens.INDEXED)
    return evaluate.flagged_outcomes(derived, evaluate.flagged_matches(derived, _flags(spark, d)))


def red_outcomes(spark, d):
    """The same with articles of red documents as the flagged ones."""
    derived = _derived(spark, d, *tokens.INDEXED)
    return evaluate.flagged_outcomes(derived, evaluate.flagged_matches(derived, _red(spark, d)))


def outcomes_sensitive(spark, d):
    """Outcomes under thresholds that every reason and outcome reaches: hubs of two articles, address and document author for b0, a lower score, red documents as flags."""
    index = _index(spark, d)
    return evaluate.outcomes(index, pairs.peer_counts(pairs.scored_pairs(index)), _red(spark, d), **SENSITIVE)


def flags_history(spark, d):
    """Every flag event, and whether its article is in the index."""
    inside = _index(spark, d).select("article_id").distinct().withColumn("in_index", F.lit(True))
    return read(spark, d, "flags").join(inside, "article_id", "left").withColumn("in_index", F.coalesce("in_index", F.lit(False)))


def flags_summary(spark, d):
    """Flag events per status, with articles and comments."""
    f = read(spark, d, "flags")
    return f.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("article_id").alias("n_articles"), F.count_if(F.coalesce("comment", F.lit("")) != "").alias("n_comments"))


def device_reuse(spark, d):
    """Articles, organisations, languages and time zones seen with each device."""
    one = _derived(spark, d, "article_id", "device", "author_org", "locale").where("device <> ''").withColumn("org", F.nullif("author_org", F.lit(""))).withColumn("loc", F.nullif("locale", F.lit("")))
    return one.groupBy("device").agg(F.count("*").alias("n_articles"), F.count_distinct("org").alias("n_orgs"), F.count_distinct("loc").alias("n_locales"))


def cap_skips(spark, d):
    """Per attribute the values above the cap and their share of all."""
    f = token_df(spark, d)
    over = (F.col("df") > tokens.cap_of(tokens.CAPS)).cast("int")
    return f.groupBy("attr").agg(F.sum(over).alias("n_over"), report.half_up(F.avg(over), 6).alias("skip_rate"))


def ops_metrics(spark, d):
    """Share of values above the cap, and shares of articles by what marks them."""
    o = outcomes_legacy(spark, d)
    skips = token_df(spark, d).agg(report.half_up(F.avg((F.col("df") > tokens.cap_of(tokens.CAPS)).cast("int")), 6).alias("cap_skip_rate"))
    block = F.col("outcome") == "BLOCK"
    rates = o.agg(F.count("*").alias("n"), report.half_up(F.avg(block.cast("int")), 4).alias("block_rate"), report.half_up(F.avg("b1"), 4).alias("b1_rate"), report.half_up(F.avg("b2"), 4).alias("b2_rate"), F.count_if(block & (F.col("n_peers") == 1)).alias("single_peer_blocks"))
    return rates.withColumn("cap_skip_rate", F.lit(skips.first()[0]).cast("double"))


def score_by_label(spark, d):
    """Distribution of the largest score in eight groups."""
    return report.scores_by_label(_labels(spark, d))


def label_prevalence(spark, d):
    """Share of articles with each label."""
    return report.prevalence(_labels(spark, d))


def warn_sweep(spark, d):
    """Rate, recall and precision at sixteen thresholds."""
    return report.sweep(_labels(spark, d))


def best_threshold(spark, d):
    """The threshold the sweep recommends."""
    return report.best_threshold(warn_sweep(spark, d))


def type_lift(spark, d):
    """Lift of each attribute among best peers."""
    return report.lift(cut(_labels(spark, d)), best_peer(spark, d))


def match_patterns(spark, d):
    """Commonest combinations of matched attributes."""
    return report.patterns(pair_scores(spark, d))


def kept_bucket_sizes(spark, d):
    """Sizes of kept values against the caps."""
    return report.bucket_sizes(hub_stats(spark, d))


def encoded_enums(spark, d):
    """Enumerations of the export as numbers."""
    a = _derived(spark, d, "article_id", "pm_score", "pm_band", "wd_status", "wd_match", "email_pattern")
    code = messages.code_of
    return a.select("article_id", report.half_up("pm_score", 2).alias("pm_score"), code(F.col("pm_band"), messages.BAND_CODE).alias("pm_band"), code(F.col("wd_status"), messages.STATUS_CODE).alias("wd_status"), messages.tri_state(F.col("wd_match")).alias("wd_match"), code(F.col("email_pattern"), messages.PATTERN_CODE).alias("email_pattern"))


def explorer_hubs(spark, d):
    """Network hubs of different authors and organisations within one article type."""
    articles = _derived(spark, d, "article_id", "article_type").where("article_type = 'Original Research'")
    return hubs.filtered(_index(spark, d), articles, ("ip", "device"), different_authors=True, different_orgs=True)


def pair_attr_counts(spark, d):
    """Pairs that share each attribute."""
    return report.attr_marginals(pair_scores(spark, d))


def sample_articles(spark, d):
    """Up to 15,000 articles of the index, chosen by hash."""
    return report.sample(_index(spark, d), 15_000)


def snapshot_meta(spark, d):
    """Articles, buckets and active flags of the index."""
    index = _index(spark, d)
    n = index.agg(F.count_distinct("article_id").alias("articles"), F.count_distinct("attr", "value").alias("buckets"))
    return n.withColumn("flags", F.lit(_flags(spark, d).count()).cast("bigint"))


def email_similarity_scores(spark, d):
    """Similarity of name and e-mail of every article."""
    rows = _derived(spark, d, "article_id", "author_name", "email")
    return email_similarity(rows, "author_name", "email").withColumn("name_email_sim", report.half_up("name_email_sim", 6))


def queries() -> dict:
    fs = (
        derived_articles, token_unpivot, token_df, token_df_stats, token_top_sizes, kept_buckets, connected_articles, hub_stats, hub_eligible, hub_author_share, hub_adjacency, hub_drilldown, compare_shared,
        pair_bitmask, pair_scores, pair_score_summary, peer_topk, best_peer, peer_counts, passing_attrs, outcomes_legacy, outcome_rates, outcomes_sensitive, flagged_matches, red_matches, flagged_outcomes, red_outcomes, flags_history, flags_summary, device_reuse, cap_skips, ops_metrics,
        score_by_label, label_prevalence, warn_sweep, best_threshold, type_lift, match_patterns, kept_bucket_sizes, encoded_enums, explorer_hubs, pair_attr_counts, sample_articles, snapshot_meta, email_similarity_scores,
    )
    return {f.__name__: f for f in fs}


def _q(col: str, points, digits=6) -> str:
    return ", ".join(f"round(quantile_cont({col}, {p / 100}), {digits}) as p{p}" for p in points)


def _code(col: str, codes: dict[str, int]) -> str:
    return f"(case {col} " + " ".join(f"when '{k}' then {v}" for k, v in codes.items()) + " else 0 end)"


def oracle_sql() -> dict[str, str]:
    u = sql.upto
    ranked = tokens.RANKED
    named = "concat_ws('+', " + ", ".join(f"case when matched & {b} > 0 then '{a}' end" for a, (b, _) in sorted(ranked.items())) + ")"
    chips = "concat_ws('+', " + ", ".join(f"case when matched & {b} > 0 then '{a}' end" for a, (b, _) in ranked.items()) + ")"
    groups = {"all": "true", "b0": "b0", "near_not_b0": "near and not b0", "net_doc_not_b0": "net_doc and not b0", "structural_not_b0": "structural and not b0", "any_hub_only": "any_hub and not structural and not b0", "no_hub": "not any_hub", "red": "red"}
    grouped = " union all ".join(f"select '{k}' as label, max_all from lab where {v}" for k, v in groups.items())
    hit = "max_all >= t.threshold"
    swept = f"""select cast(t.threshold as int) as threshold, round(count(*) filter (where {hit}) / count(*), 4) as rate, round(count(*) filter (where {hit} and not (b0 or red)) / count(*), 4) as warn_rate,
  round(count(*) filter (where {hit} and structural) / nullif(count(*) filter (where structural), 0), 4) as recall_structural, round(count(*) filter (where {hit} and structural) / nullif(count(*) filter (where {hit}), 0), 4) as precision_structural,
  round(count(*) filter (where {hit} and b0) / nullif(count(*) filter (where b0), 0), 4) as recall_b0, round(count(*) filter (where {hit} and red) / nullif(count(*) filter (where red), 0), 4) as recall_red,
  round(avg(n_all) filter (where {hit}), 1) as mean_peers from lab, (select unnest(range(6, 37, 2)) as threshold) t group by 1"""
    outcomes = f""", theirs as (select x.article_id as subject, y.article_id as peer from passed x join idx y on x.attr = y.attr and x.value = y.value join flag on flag.article_id = y.article_id where x.article_id <> y.article_id),
b1s as (select distinct side.subject as article_id from side join theirs on theirs.subject = side.subject and theirs.peer = side.peer where matched & 3 > 0 and matched & 12 > 0),
o as (select al.article_id, coalesce(max_score, 0.0) as max_score, coalesce(n_peers, 0) as n_peers, cast(coalesce(passed = 15, false) as int) as b0, cast(b1s.article_id is not null as int) as b1, cast(art.wd_status = 'red' as int) as b2
  from (select distinct article_id from idx) al join art using (article_id) left join counts using (article_id) left join labels0 using (article_id) left join b1s using (article_id)),
oo as (select *, case when b0 + b1 + b2 > 0 then 'BLOCK' when max_score >= 34 then 'WARN' else 'PASS' end as outcome from o)
"""
    flagged = f"""{sql.with_(sql.ART, sql.TOK, sql.FREQ, sql.FLAGS)},
low as (select tok.*, created_on, author_org from tok join freq using (attr, value) join art using (article_id) where df <= {sql.CAP} and attr in ({sql.RANKED_LIST})),
met as (select x.article_id as subject, y.article_id as peer, x.created_on as created_a, y.created_on as created_b, x.author_org as org_a, y.author_org as org_b, bit_or(case x.attr {" ".join(f"when '{a}' then {b}" for a, (b, _) in ranked.items())} end) as matched
  from low x join low y on x.attr = y.attr and x.value = y.value and x.article_id <> y.article_id join flag on flag.article_id = y.article_id group by 1, 2, 3, 4, 5, 6),
sc as (select *, cast({sql.SCORE} as double) as score from met where matched & 3 > 0 and matched & 12 > 0)
select subject, peer, matched, score, cast(rank as int) as rank, match_total, {chips} as chips from (
  select *, row_number() over (partition by subject order by score desc, bit_count(matched & 15) desc, created_b desc, peer) as rank, count(*) over (partition by subject) as match_total from sc) where rank <= 15
"""
    red = "flag as (select article_id from art where wd_status = 'red')"
    sensitive = (u("flag") + outcomes).replace(sql.FLAGS, red).replace("size >= 5 and n_authors >= 2 and n_orgs >= 2", "size >= 2 and n_authors >= 1 and n_orgs >= 1").replace("coalesce(share, 0) <= 0.5", "coalesce(share, 0) <= 1.0").replace("max_score >= 34", "max_score >= 12").replace("passed = 15, false) as int) as b0", "passed & 6 = 6, false) as int) as b0")
    wide = flagged.replace(sql.FLAGS, red).replace(f"df <= {sql.CAP}", f"df <= 10 * {sql.CAP}").replace("matched & 3 > 0 and matched & 12 > 0)\n", "matched & 3 > 0 and matched & 63 > 0)\n").replace("rank <= 15", "rank <= 1")
    blocked = lambda matches: f"""with m as (select subject as article_id, max(match_total) as match_total from ({matches}) group by 1), s as (select distinct article_id, cast(({sql.STATUS_NAME}) = 'red' as int) as b2 from articles_raw where article_id is not null)
select article_id, coalesce(match_total, 0) as match_total, cast(match_total is not null as int) as b1, b2, case when match_total is not null or b2 = 1 then 'BLOCK' else 'PASS' end as outcome from s left join m using (article_id)"""  # noqa: E731
    checks = {
        "derived_articles": u("art") + "select * from art",
        "token_unpivot": u("tok") + "select attr, value, article_id from tok",
        "token_df": u("freq") + "select * from freq",
        "token_df_stats": u("freq") + f""", f as (select *, {sql.CAP} as cap from freq)
select attr, cap, count(*) as n_values, cast(sum(df) as bigint) as n_articles, {_q("df", (50, 90, 95, 99))}, max(df) as size_max, count(*) filter (where df > cap) as values_over_cap, cast(coalesce(sum(df) filter (where df > cap), 0) as bigint) as mass_over_cap,
  round(coalesce(sum(df) filter (where df > cap), 0) / sum(df), 4) as pct_over_cap, count(*) filter (where df = 1) as singletons, count(*) filter (where df between 2 and cap) as values_2_to_cap, count(*) filter (where df between 5 and cap) as values_5_to_cap from f group by 1, 2""",
        "token_top_sizes": u("freq") + "select attr, cast(rank as int) as rank, value, df from (select *, row_number() over (partition by attr order by df desc, value) as rank from freq) where rank <= 5",
        "kept_buckets": u("kept") + "select distinct attr, value, df from kept join freq using (attr, value)",
        "connected_articles": u("alive") + "select * from alive",
        "hub_stats": u("hub") + "select * from hub",
        "hub_eligible": u("hub") + f"select * from hub where attr in ('device', 'ip', 'wd_author', 'wd_edited_by') and size >= 5 and n_authors >= 2 and n_orgs >= 2 and size <= {sql.CAP}",
        "hub_author_share": u("idx") + "select attr, value, author_name, count(*) as n, round(count(*) / max(size), 6) as share from idx where author_name <> '' group by 1, 2, 3",
        "hub_adjacency": u("idx") + "select x.attr as attr_a, x.value as value_a, y.attr as attr_b, y.value as value_b, count(*) as shared from idx x join idx y on x.article_id = y.article_id and (x.attr, x.value) < (y.attr, y.value) where x.attr in ('device', 'ip', 'wd_author', 'wd_edited_by') and y.attr in ('device', 'ip', 'wd_author', 'wd_edited_by') group by 1, 2, 3, 4",
        "hub_drilldown": u("hub") + "select article_id, attr, value from idx where article_id in (select article_id from idx where attr = 'ip' and value = (select value from hub where attr = 'ip' order by size desc, value limit 1))",
        "compare_shared": sql.with_(sql.ART, sql.TOK, sql.FLAGS) + "select article_id, attr, value, count(*) over (partition by attr, value) > 1 as shared from tok join flag using (article_id)",
        "pair_bitmask": u("pair") + "select a, b, matched from pair",
        "pair_scores": u("pair") + "select * from pair",
        "pair_score_summary": u("pair") + f"select count(*) as n_pairs, {_q('score', (10, 25, 50, 75, 90, 95, 99), 2)}, round(avg(score), 2) as mean from pair",
        "peer_topk": u("pair") + f"select subject, peer, matched, score, cast(rank as int) as rank from (select *, row_number() over (partition by subject order by score desc, {sql.FIRST}, peer) as rank from side where score >= 3) where rank <= 20",
        "best_peer": u("pair") + f"select subject, peer, matched, score from (select *, row_number() over (partition by subject order by score desc, {sql.FIRST}, peer) as rank from side) where rank = 1",
        "peer_counts": u("counts") + "select * from counts",
        "passing_attrs": u("passed") + "select article_id, passed, cast(bit_count(passed) as int) as n_passed, passed = 15 as all_four, bit_count(passed) >= 3 as near, (passed & 3 > 0 and passed & 12 > 0) as net_doc from labels0",
        "outcomes_legacy": u("flag") + outcomes + "select article_id, max_score, n_peers, b0, b1, b2, outcome from oo",
        "outcome_rates": u("flag") + outcomes + "select outcome, count(*) as n, cast(sum(b0) as bigint) as n_b0, cast(sum(b1) as bigint) as n_b1, cast(sum(b2) as bigint) as n_b2 from oo group by 1",
        "ops_metrics": u("flag") + outcomes + "select count(*) as n, round(avg(cast(outcome = 'BLOCK' as int)), 4) as block_rate, round(avg(b1), 4) as b1_rate, round(avg(b2), 4) as b2_rate, count(*) filter (where outcome = 'BLOCK' and n_peers = 1) as single_peer_blocks, " + f"(select round(avg(cast(df > {sql.CAP} as int)), 6) from freq) as cap_skip_rate from oo",
        "outcomes_sensitive": sensitive + "select article_id, max_score, n_peers, b0, b1, b2, outcome from oo",
        "red_matches": wide,
        "flagged_outcomes": blocked(flagged),
        "red_outcomes": blocked(flagged.replace(sql.FLAGS, red)),
        "flagged_matches": flagged,
        "flags_history": u("idx") + "select flags.*, coalesce(flags.article_id in (select article_id from idx), false) as in_index from flags",
        "flags_summary": "select status, count(*) as n, count(distinct article_id) as n_articles, count(*) filter (where coalesce(comment, '') <> '') as n_comments from flags group by 1",
        "device_reuse": u("art") + "select device, count(*) as n_articles, count(distinct nullif(author_org, '')) as n_orgs, count(distinct nullif(locale, '')) as n_locales from art where device <> '' group by 1",
        "cap_skips": u("freq") + f"select attr, cast(sum(cast(df > {sql.CAP} as int)) as bigint) as n_over, round(avg(cast(df > {sql.CAP} as int)), 6) as skip_rate from freq group by 1",
        "score_by_label": u("lab") + f"select label, count(*) as n, {_q('max_all', (10, 25, 50, 75, 90, 95), 2)}, round(avg(max_all), 2) as mean from ({grouped}) group by 1",
        "label_prevalence": u("lab") + "select " + ", ".join(f"round(avg(cast({c} as int)), 4) as {c}" for c in ("b0", "near", "net_doc", "structural", "red", "any_hub")) + " from lab",
        "warn_sweep": u("lab") + swept,
        "best_threshold": u("lab") + f""", swept as ({swept}), g as (select *, warn_rate between 0.03 and 0.12 and coalesce(precision_structural, 0) >= 0.4 as good from swept)
select * exclude (good) from g order by good desc, case when good then -precision_structural end, case when good then round(abs(warn_rate - 0.06), 6) else round(abs(warn_rate - 0.07), 6) end, threshold limit 1""",
        "type_lift": u("lab") + f""", best as (select * from (select *, row_number() over (partition by subject order by score desc, {sql.FIRST}, peer) as rank from side) where rank = 1),
base as (select avg(cast(structural or b0 as int)) as r from lab),
hit as (select attr, weight, cast(structural or b0 as int) as y from best join lab on lab.article_id = subject, (values {", ".join(f"('{a}', {b}, {w})" for a, (b, w) in ranked.items())}) v(attr, bit, weight) where matched & bit > 0)
select attr, count(*) as n, round(avg(y), 4) as rate, round((select r from base), 4) as baseline, round(avg(y) / nullif((select r from base), 0), 3) as lift, weight from hit group by attr, weight""",
        "match_patterns": u("pair") + f"select {named} as pattern, count(*) as n_pairs, round(avg(score), 2) as score_mean, round(quantile_cont(score, 0.5), 2) as score_p50, case when round(min(score), 2) = round(max(score), 2) then round(min(score), 2) end as score_fixed from pair group by 1 order by 2 desc, 1 limit 25",
        "kept_bucket_sizes": u("hub") + f"select attr, {sql.CAP} as cap, count(*) as buckets, {_q('size', (50, 90, 99))}, max(size) as size_max, round(avg(cast(size >= {sql.CAP} * 0.8 as int)), 4) as pct_near_cap from hub where attr in ({sql.RANKED_LIST}) group by 1, 2",
        "encoded_enums": u("art") + f"select article_id, round(pm_score, 2) as pm_score, {_code('pm_band', messages.BAND_CODE)} as pm_band, {_code('wd_status', messages.STATUS_CODE)} as wd_status, coalesce(cast(wd_match as int), -1) as wd_match, {_code('email_pattern', messages.PATTERN_CODE)} as email_pattern from art",
        "explorer_hubs": u("idx") + "select attr, value, count(*) as size, count(distinct nullif(author_name, '')) as n_authors, count(distinct nullif(author_org, '')) as n_orgs from idx where attr in ('ip', 'device') and article_id in (select article_id from art where article_type = 'Original Research') group by 1, 2 having count(*) >= 2 and count(distinct nullif(author_name, '')) >= 2 and count(distinct nullif(author_org, '')) >= 2",
        "pair_attr_counts": u("pair") + " union all ".join(f"select '{a}' as attr, count(*) filter (where matched & {b} > 0) as n_pairs from pair" for a, (b, _) in ranked.items()),
        "sample_articles": u("idx") + "select article_id from (select distinct article_id from idx) order by md5('42|' || article_id), article_id limit 15000",
        "snapshot_meta": sql.with_(sql.ART, sql.TOK, sql.FREQ, sql.KEPT, sql.ALIVE, sql.IDX, sql.FLAGS) + "select (select count(distinct article_id) from idx) as articles, (select count(*) from (select distinct attr, value from idx)) as buckets, (select count(*) from flag) as flags",
    }
    return {name: sql.half_up(text) for name, text in checks.items()}
