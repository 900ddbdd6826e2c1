"""Queries of sources, latest rows, refresh and backfill over the raw tables, and the context star over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligature.functions import messages
from ligature.functions.profile import REQUIRED, device_token, profile_errors, profile_id, profile_key
from ligature.functions.text import clean, display_name, email_pattern, full_name, local_part
from ligature.operators import latest, nested, refresh, report
from ligature.plans import sql
from ligature.runtime import read, small
from ligature.sources import tables

#: The instant every window is measured from.
AS_OF, DAYS, REFRESH_DAYS = "2001-04-01 00:00:00", 60, 14


def _recent(spark, d) -> DataFrame:
    return tables.recent_articles(read(spark, d, "resources"), AS_OF, DAYS)


def _articles(spark, d) -> DataFrame:
    return read(spark, d, "articles_raw").where("article_id is not null")


def recent_articles_window(spark, d):
    """Articles of the window."""
    return _recent(spark, d)


def aged_articles(spark, d):
    """Articles that left the window, or have no time."""
    r = read(spark, d, "resources").where("resource_type_definition_id = 1 and external_id is not null")
    return refresh.aged(r, "created", AS_OF, DAYS).select(F.col("id").alias("resource_id"), F.col("external_id").alias("article_id"), "created").distinct()


def latest_fingerprint(spark, d):
    """The latest fingerprint of the window's articles."""
    return tables.latest_fingerprints(read(spark, d, "device_fingerprints"), _recent(spark, d))


def indicators_latest_row(spark, d):
    """Both indicators of the window's articles, as their last row has them."""
    return tables.indicators(read(spark, d, "indicators"), _recent(spark, d))


def indicators_latest_non_null(spark, d):
    """Both indicators, each column's last value that isn't null."""
    return tables.indicators(read(spark, d, "indicators"), _recent(spark, d), whole_rows=False)


def primary_author_pick(spark, d):
    """First known value of each author column by role."""
    return tables.primary_author(read(spark, d, "author_metadata"))


def author_ip(spark, d):
    """Address of the first author that has one."""
    return tables.author_ip(read(spark, d, "author_metadata"))


def author_display_names(spark, d):
    """Display name, full name and local part of every author row."""
    a = read(spark, d, "author_metadata").where("article_id is not null")
    n = [F.col(c) for c in ("first_name", "middle_name", "last_name")]
    return a.select("article_id", "email", display_name(*n).alias("display_name"), full_name(*n).alias("full_name"), local_part(F.col("email")).alias("local_part")).distinct()


def latest_version(spark, d):
    """The latest version of each resource."""
    return tables.latest_versions(read(spark, d, "resource_version")).select("resource_id", "id", "version")


def model_scalars(spark, d):
    """Stage, title, journal and section of each latest version."""
    return tables.model_scalars(tables.latest_versions(read(spark, d, "resource_version")))


def author_json_pick(spark, d):
    """One author of each record's JSON."""
    return tables.author_pick(nested.flatten(read(spark, d, "resource_version")))


def submitting_author(spark, d):
    """Name, e-mail and affiliation of the submitting author of each record's JSON."""
    return tables.submitting_author(nested.flatten(read(spark, d, "resource_version")))


def all_authors(spark, d):
    """Name, e-mail, role and organisation of every author of each record's JSON."""
    return tables.all_authors(nested.flatten(read(spark, d, "resource_version")))


def clean_placeholders(spark, d):
    """Placeholders of the typed columns emptied."""
    return _articles(spark, d).select("article_id", *(clean(F.col(c)).alias(c) for c in ("author_name", "author_email", "author_org", "ip_hash", "languages"))).distinct()


def email_patterns(spark, d):
    """Articles per shape of the e-mail."""
    return _articles(spark, d).select("article_id", email_pattern(F.lower(clean(F.col("author_email")))).alias("pattern")).distinct().groupBy("pattern").agg(F.count("*").alias("n"))


def papermill_message_parse(spark, d):
    """Score and band of the risk message."""
    m = F.col("pm_message")
    return _articles(spark, d).select("article_id", messages.risk_score(m).alias("score"), messages.risk_band(m).alias("band"), messages.status_name(F.col("pm_status")).alias("status")).distinct()


def worddoc_message_parse(spark, d):
    """Properties in the document message."""
    m = F.col("wd_message")
    return _articles(spark, d).select("article_id", messages.document_field(m, "Author").alias("author"), messages.document_field(m, "Last modified by").alias("edited_by"), messages.document_field(m, "Company").alias("company"), messages.document_match(m).alias("matches")).distinct()


def device_profile_hash(spark, d):
    """Key, digest and token of the device profile."""
    return _articles(spark, d).select("article_id", profile_key().alias("profile_key"), profile_id().alias("profile_id"), device_token().alias("token"), device_token(strict=True).alias("strict_token"), F.size(profile_errors()).alias("n_missing")).distinct()


def assembled_articles(spark, d):
    """The article table of the window, put together from its parts."""
    context = _articles(spark, d).select("article_id", "author_name", "author_email", "author_org", "journal", "section", "stage_name").distinct()
    return tables.assemble(read(spark, d, "resources"), read(spark, d, "device_fingerprints"), read(spark, d, "indicators"), read(spark, d, "author_metadata"), context, AS_OF, DAYS)


def _cache_and_fresh(spark, d):
    cols = ["article_id", "created", "author_name", "author_org", "journal"]
    a = _articles(spark, d).select(*cols).distinct()
    cache = a.withColumn("journal", F.lit("cached"))
    return cache, refresh.within(a, "created", AS_OF, REFRESH_DAYS)


def incremental_splice(spark, d):
    """The cached window with its last days taken afresh."""
    return refresh.splice(*_cache_and_fresh(spark, d), "article_id", "created", AS_OF, DAYS)[0]


def archive_dedup(spark, d):
    """Rows that aged out, appended to an archive that holds some of them."""
    cache, fresh = _cache_and_fresh(spark, d)
    _, gone = refresh.splice(cache, fresh, "article_id", "created", AS_OF, DAYS)
    previous = refresh.aged(cache, "created", AS_OF, DAYS + 10).withColumn("journal", F.lit("archived"))
    return refresh.archive(previous, gone, "article_id")


def context_replace(spark, d):
    """Author columns replaced by those of the author table, null where it has none."""
    a = _articles(spark, d).select("article_id", "author_email", "author_org", "journal").distinct()
    new = tables.primary_author(read(spark, d, "author_metadata")).select("article_id", F.lower("email").alias("author_email"), F.col("organisation").alias("author_org"))
    return refresh.replace_columns(a, new, "article_id")


def fill_if_empty(spark, d):
    """Empty author columns filled from the author table."""
    a = _articles(spark, d).select("article_id", "author_email", "author_org").distinct()
    new = tables.primary_author(read(spark, d, "author_metadata")).select("article_id", F.col("email").alias("author_email"), F.col("organisation").alias("author_org"))
    return refresh.fill_if_empty(a, new, "article_id", ("author_email", "author_org"), lambda c: clean(c) == "")


def rotate_shifted(spark, d):
    """Columns that slipped by one put back, with what shows it."""
    a = _articles(spark, d).select("article_id", "author_name", "author_email", "author_org").distinct()
    return refresh.rotate_shifted(a.withColumn("was_shifted", refresh.shifted()))


def context_coverage(spark, d):
    """Filled rows per context column."""
    return report.coverage(_articles(spark, d).select("article_id", "author_email", "journal", "editors", "reviewers", "rejection_reason").distinct(), ("author_email", "journal", "editors", "reviewers", "rejection_reason"))


def editorial_context_star(spark, d):
    """Orders with customer, nation, region and their first three suppliers: a star with a bounded ordered list per key."""
    o, c, n, r = (read(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    names = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct().join(small(read(spark, d, "supplier").select("s_suppkey", "s_name")), F.col("l_suppkey") == F.col("s_suppkey"))
    top = latest.ordered_list(names, ["l_orderkey"], F.col("s_name"), 3, "suppliers")
    places = small(n.join(small(r), n.n_regionkey == r.r_regionkey, "left").select("n_nationkey", "n_name", "r_name"))
    star = o.join(c, o.o_custkey == c.c_custkey, "left").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(top, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return star.select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "c_name", "n_name", "r_name", "suppliers")


def json_props_extract(spark, d):
    """A scalar of the events' JSON, as text and as a number."""
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.expr("try_cast(get_json_object(props, '$.k') as int)").alias("k_int"))


def latest_line_per_order(spark, d):
    """The latest line of each order."""
    li = read(spark, d, "lineitem")
    order = [F.desc(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return latest.best_row(li, ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("l_shipdate"))


def queries() -> dict:
    fs = (
        recent_articles_window, aged_articles, latest_fingerprint, indicators_latest_row, indicators_latest_non_null, primary_author_pick, author_ip, author_display_names, latest_version, model_scalars, author_json_pick, submitting_author, all_authors,
        clean_placeholders, email_patterns, papermill_message_parse, worddoc_message_parse, device_profile_hash, assembled_articles, incremental_splice, archive_dedup, context_replace, fill_if_empty, rotate_shifted,
        context_coverage, editorial_context_star, json_props_extract, latest_line_per_order,
    )
    return {f.__name__: f for f in fs}


RECENT = f"recent as (select distinct id as resource_id, external_id as article_id, created from resources where resource_type_definition_id = 1 and external_id is not null and created >= timestamp '{AS_OF}' - interval {DAYS} day)"
FP = ", ".join(tables.FINGERPRINT)
RANK = "(case lower(coalesce(role, '')) when 'submitting author' then 0 when 'corresponding author' then 1 else 2 end)"
_AUTHOR = ("first_name", "middle_name", "last_name", "email", "organisation", "ip_address")
_ORDER = ", ".join([RANK, *(f"coalesce({c}, chr(65535))" for c in _AUTHOR)])
PRIMARY = "prim as (select article_id, " + ", ".join(f"first({c} order by {_ORDER}) filter (where {c} is not null) as {c}" for c in _AUTHOR) + " from author_metadata where article_id is not null group by 1)"
LATEST_FP = f"fp as (select article_id, {FP} from (select *, row_number() over (partition by article_id order by last_enrich_utc desc nulls last, id desc) as rn from (select distinct * from device_fingerprints) where article_id in (select article_id from recent)) where rn = 1)"
IP = f"ip as (select article_id, first(ip_address order by {RANK}, ip_address) as author_ip from author_metadata where article_id is not null and trim(coalesce(ip_address, '')) <> '' group by 1)"
ART0 = "a as (select distinct article_id, created, author_name, author_org, journal from articles_raw where article_id is not null)"


def _indicator(whole: bool) -> str:
    def one(kind: int, name: str, c: str) -> str:
        extra = "" if whole else f" and {c} is not null"
        nulls = "nulls last"
        return f"first({c} order by indicators.created desc {nulls}, status desc {nulls}, message desc {nulls}) filter (where indicator_definition_id = {kind}{extra}) as {name}_{c}"

    return "ind as (select article_id, " + ", ".join(one(k, n, c) for k, n in ((75, "wd"), (80, "pm")) for c in ("status", "message")) + " from indicators join recent using (resource_id) where indicator_definition_id in (75, 80) group by 1)"


def oracle_sql() -> dict[str, str]:
    c, w = sql.clean, sql.with_
    old = f"timestamp '{AS_OF}' - interval {DAYS} day"
    names = "trim(concat_ws(' ', nullif(first_name, ''), nullif(middle_name, ''), nullif(last_name, '')), " + sql.W + ")"
    missing = " + ".join(f"cast({sql.part(f'cast({x} as varchar)')} = '' as int)" for x in REQUIRED)
    digest = f"(case when regexp_full_match({sql.KEY}, '\\|*') then {sql.part('device_id')} else sha256({sql.KEY}) end)"
    splice = f", m as (select * from a where created >= timestamp '{AS_OF}' - interval {REFRESH_DAYS} day union all select article_id, created, author_name, author_org, 'cached' from a where created >= {old} and not created >= timestamp '{AS_OF}' - interval {REFRESH_DAYS} day) "
    return {
        "recent_articles_window": w(RECENT) + "select * from recent",
        "aged_articles": f"select distinct id as resource_id, external_id as article_id, created from resources where resource_type_definition_id = 1 and external_id is not null and (created is null or created < {old})",
        "latest_fingerprint": w(RECENT, LATEST_FP) + "select * from fp",
        "indicators_latest_row": w(RECENT, _indicator(True)) + "select * from ind",
        "indicators_latest_non_null": w(RECENT, _indicator(False)) + "select * from ind",
        "primary_author_pick": w(PRIMARY) + "select * from prim",
        "author_ip": w(IP) + "select * from ip",
        "author_display_names": f"select distinct article_id, email, {names} as display_name, nullif(trim(regexp_replace(coalesce(first_name, '') || ' ' || coalesce(middle_name, '') || ' ' || coalesce(last_name, ''), ' +', ' ', 'g')), '') as full_name, case when contains(coalesce(email, ''), '@') then split_part(email, '@', 1) else '' end as local_part from author_metadata where article_id is not null",
        "latest_version": "select distinct resource_id, id, version from (select *, row_number() over (partition by resource_id order by coalesce(version, -1) desc, id desc) as rn from (select distinct id, resource_id, version from resource_version where resource_id is not null and id is not null)) where rn = 1",
        "model_scalars": """
with t as (select distinct resource_id, id, trim(resource_model, chr(65279) || chr(9) || chr(10) || chr(13) || ' ') as text from (select *, row_number() over (partition by resource_id order by coalesce(version, -1) desc, id desc) as rn from (select distinct id, resource_id, version, resource_model from resource_version where resource_id is not null and id is not null)) where rn = 1),
v as (select *, try_cast(text as json) as j from t),
r as (select resource_id, id, case when json_type(j) = 'VARCHAR' then try_cast(json_extract_string(j, '$') as json) else j end as j from v)
select resource_id, id, try_cast(json_extract_string(j, '$.review.stage.id') as int) as stage_id, json_extract_string(j, '$.review.stage.name') as stage_name, json_extract_string(j, '$.submission.manuscriptDetails.title') as title, json_extract_string(j, '$.submission.manuscriptDetails.journalName') as journal, json_extract_string(j, '$.submission.manuscriptDetails.sectionName') as section from r
""",
        "author_json_pick": f"""{sql.JSON_AUTHORS},
named as (select id, author_pos, {c("json_extract_string(e, '$.fullName')")} as name, {c("json_extract_string(e, '$.primaryEmail')")} as email, json_extract_string(e, '$.isSubmittingAuthor') as s, json_extract_string(e, '$.isCorrespondingAuthor') as k from o),
one as (select *, row_number() over (partition by id order by case when s = 'true' then 0 when k = 'true' then 1 else 2 end, author_pos) as rn from named where name <> '' or email <> ''),
org as (select id, author_pos, json_extract_string(e, '$.name') as org from g where affil_pos = 0 and json_type(e) = 'OBJECT')
select one.id as version_id, one.author_pos, name, email, {c("org")} as org from one left join org using (id, author_pos) where rn = 1""",
        "submitting_author": f"""{sql.JSON_AUTHORS}, {sql.JSON_NAMED},
one as (select *, row_number() over (partition by id order by case when s then 0 else 1 end, author_pos) as rn from named)
select id as version_id, nullif(name, '') as name, email, case when has_primary then primary_org else first_org end as affiliation from one where rn = 1""",
        "all_authors": f"""{sql.JSON_AUTHORS}, {sql.JSON_NAMED}
select id as version_id, author_pos, name, coalesce(trim(email, {sql.W}), '') as email, case when s then 'Submitting author' else 'Author' end as role, coalesce(nullif(trim(primary_org, {sql.W}), ''), trim(first_org, {sql.W}), '') as org from named""",
        "clean_placeholders": "select distinct article_id, " + ", ".join(f"{c(x)} as {x}" for x in ("author_name", "author_email", "author_org", "ip_hash", "languages")) + " from articles_raw where article_id is not null",
        "email_patterns": f"select pattern, count(*) as n from (select distinct article_id, {sql.pattern(sql.EMAIL)} as pattern from articles_raw where article_id is not null) group by 1",
        "papermill_message_parse": w(sql.ART) + "select art.article_id, pm_score as score, pm_band as band, s.status from art join (select distinct article_id, " + sql.STATUS_NAME.replace("wd_status", "pm_status") + " as status from articles_raw) s using (article_id)",
        "worddoc_message_parse": w(sql.ART) + "select article_id, wd_author as author, wd_edited_by as edited_by, wd_company as company, wd_match as matches from art",
        "device_profile_hash": f"select distinct article_id, case when regexp_full_match({sql.KEY}, '\\|*') then '' else {sql.KEY} end as profile_key, {digest} as profile_id, {sql.DEVICE} as token, case when {missing} = 0 then {sql.DEVICE} else '' end as strict_token, {missing} as n_missing from articles_raw where article_id is not null",
        "assembled_articles": w(RECENT, LATEST_FP, _indicator(True), IP, "ctx as (select distinct article_id, author_name, author_email, author_org, journal, section, stage_name from articles_raw where article_id is not null)")
        + f"select recent.article_id, created, {FP}, wd_status, wd_message, pm_status, pm_message, author_ip, author_name, author_email, author_org, journal, section, stage_name from recent left join fp using (article_id) left join ind using (article_id) left join ip using (article_id) left join ctx using (article_id)",
        "incremental_splice": w(ART0) + splice + "select * from m",
        "archive_dedup": w(ART0) + f"select article_id, created, author_name, author_org, 'cached' as journal from a where created is null or created < {old}",
        "context_replace": w(PRIMARY) + "select a.article_id, journal, lower(prim.email) as author_email, organisation as author_org from (select distinct article_id, author_email, author_org, journal from articles_raw where article_id is not null) a left join prim using (article_id)",
        "fill_if_empty": w(PRIMARY) + f"select a.article_id, case when {c('author_email')} = '' then coalesce(prim.email, author_email) else author_email end as author_email, case when {c('author_org')} = '' then coalesce(organisation, author_org) else author_org end as author_org from (select distinct article_id, author_email, author_org from articles_raw where article_id is not null) a left join prim using (article_id)",
        "rotate_shifted": "select article_id, case when s then author_email else author_name end as author_name, case when s then author_org else author_email end as author_email, case when s then '' else author_org end as author_org, s as was_shifted from (select distinct article_id, author_name, author_email, author_org, contains(coalesce(author_org, ''), '@') and not contains(coalesce(author_email, ''), '@') as s from articles_raw where article_id is not null)",
        "context_coverage": "select count(*) as n_rows, " + ", ".join(f"count(*) filter (where trim(coalesce({x}, '')) <> '') as n_{x}" for x in ("author_email", "journal", "editors", "reviewers", "rejection_reason")) + " from (select distinct article_id, author_email, journal, editors, reviewers, rejection_reason from articles_raw where article_id is not null)",
        "editorial_context_star": """
with n as (select distinct l_orderkey, s_name from lineitem join supplier on l_suppkey = s_suppkey),
t as (select l_orderkey, string_agg(s_name, ',' order by s_name) as suppliers from (select *, row_number() over (partition by l_orderkey order by s_name) as rn from n) where rn <= 3 group by 1)
select o_orderkey, cast(o_orderdate as date) as o_orderdate, c_name, n_name, r_name, suppliers from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey left join t on l_orderkey = o_orderkey
""",
        "json_props_extract": "select event_id, json_extract_string(props, '$.k') as k, try_cast(json_extract_string(props, '$.k') as int) as k_int from events",
        "latest_line_per_order": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate as date) as l_shipdate from (select *, row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) as rn from lineitem) where rn = 1",
    }
