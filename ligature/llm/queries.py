"""The queries p1, p2 and p5 to p9 and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligature.llm import components, garbled, leaks, names, setsim, terms, tokenize
from ligature.runtime import read


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per linked spelling or article with its entity and the rarity of what links it."""
    return names.rarity(*names.variants(read(spark, sf_dir, "articles_raw")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked spellings of institutions and rows of authors."""
    return names.linked(*names.variants(read(spark, sf_dir, "articles_raw")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that share ip_hash or device_id, with one group id."""
    articles = read(spark, sf_dir, "articles_raw")
    return components.groups(articles, "article_id", ["ip_hash", "device_id"], read(spark, sf_dir, "shared_values")).select(F.col("id").alias("article_id"), "group_id")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and articles of every hash and language tag, with its mark or null."""
    articles = read(spark, sf_dir, "articles_raw")
    total = articles.agg(F.count_distinct("article_id")).first()[0]
    return terms.marks(terms.frequencies(terms.tokens(articles, "article_id", ["ip_hash", "asn_hash"], ["languages"]), total), total)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common to be evidence."""
    return p5_counts(spark, sf_dir).where("mark is not null").select("attr_name", "term", "mark")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of articles whose sets of devices, addresses and time zones overlap strongly."""
    sets = setsim.value_sets(read(spark, sf_dir, "device_fingerprints"), "article_id", ["device_id", "ip_hash", "timezone"])
    return setsim.similar_pairs(sets, num=3, den=5, min_size=4).select("left_id", "right_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return tokenize.encode_corpus(read(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts decoded from their ids again."""
    return tokenize.decode_corpus(p7_ids(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails that hold ten words in a row of an evaluation item."""
    return leaks.leaked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"), window=10, radius=3, similarity=0.8)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails with characters from wrongly decoded bytes."""
    return garbled.garbled(read(spark, sf_dir, "documents"))[0].select("doc_id").distinct()


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those mails with their text restored where that is possible."""
    return garbled.restored(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_entities, p2_found, p5_found, p5_counts, p6_found, p7_ids, p7_decoded, p8_found, p9_found, p9_restored)}


def _norm(column: str) -> str:
    value = f"lower(trim({column}, ' ' || chr(9)))"
    return f"case when {value} in ('', 'na', 'n/a', 'none', 'nan', 'null', 'unknown', '-') then null else {value} end"


_P5 = f"""
with rows_ as (select article_id, {_norm("ip_hash")} as ip_hash, {_norm("asn_hash")} as asn_hash, {_norm("languages")} as languages from articles_raw where article_id is not null),
tok as (
  select 'ip_hash' as attr_name, ip_hash as term, article_id from rows_ where ip_hash is not null
  union all select 'asn_hash', asn_hash, article_id from rows_ where asn_hash is not null
  union all select 'languages', tag, article_id from (select article_id, unnest(regexp_split_to_array(replace(languages, '_', '-'), '[,;\\s\\[\\](){{}}"'']+')) as tag from rows_ where languages is not null)
    where tag <> '' and not regexp_matches(tag, '^q\\s*=')
),
counts as (select attr_name, term, count(*) as occurrences, count(distinct article_id) as records from tok group by 1, 2),
marked as (select *, case when records <= 1 then 'rare' when records > 0.02 * (select count(distinct article_id) from articles_raw) then 'common' end as mark from counts)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""
with recursive links as (
  select distinct 'ip_hash' as k, {_norm("ip_hash")} as v, article_id from articles_raw where article_id is not null
  union select distinct 'device_id', {_norm("device_id")}, article_id from articles_raw where article_id is not null
),
kept as (select * from links where v is not null and not (k = 'ip_hash' and v in (select {_norm("attr_value")} from shared_values where attr_value is not null))),
heads as (select k, v, min(article_id) as head from kept group by 1, 2 having count(*) > 1),
edges as (select kept.article_id as a, head as b from kept join heads using (k, v) union select head, kept.article_id from kept join heads using (k, v)),
reach as (select a, b from edges union select reach.a, edges.b from reach join edges on reach.b = edges.a)
select a as article_id, min(b) as group_id from reach group by 1
""",
        "p5_found": _P5 + "select attr_name, term, mark from marked where mark is not null",
        "p5_counts": _P5 + "select attr_name, term, occurrences, records, mark from marked",
        "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
        "p6_found": f"""
with v as (
  select distinct article_id, k, v from (
    select article_id, 'd' as k, {_norm("device_id")} as v from device_fingerprints
    union all select article_id, 'i', {_norm("ip_hash")} from device_fingerprints
    union all select article_id, 't', {_norm("timezone")} from device_fingerprints)
  where v is not null and article_id is not null
),
sized as (select article_id, count(*) as n from v group by 1 having count(*) >= 4),
big as (select v.*, n from v join sized using (article_id))
select a.article_id as left_id, b.article_id as right_id
from big a join big b on a.k = b.k and a.v = b.v and a.article_id < b.article_id
group by 1, 2, a.n, b.n having count(*) * 8 >= 3 * (a.n + b.n)
""",
    }
