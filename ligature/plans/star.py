"""Queries of the context star, backfills, lenient dates, sinks and streams.

The warehouse tables that the star joins are not among the test tables: they are derived from the order
tables by plain projections, which both engines read, so that every kind of join and gap occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligature.functions import messages
from ligature.functions.dates import lenient_date, naive_utc
from ligature.functions.text import clean, digits_only, has_letters, letters_and_digits, local_part
from ligature.operators import hubs, pairs, refresh, report, tokens
from ligature.operators.latest import latest_row
from ligature.plans import linkage, sourcing, sql
from ligature.runtime import read, scratch
from ligature.schema import ARTICLES, conform
from ligature.sources import context, sinks, tables
from ligature.streaming import mirror

STAR_AS_OF, STAR_DAYS = "1999-01-01 00:00:00", 700
_AUTHOR = "l_partkey * 1000 + l_suppkey as author_id"
#: Table of the star -> table it is derived from and its columns; {q} is the engine's quote.
DERIVED = {
    "articles": ("orders", ["o_orderkey as article_id", "o_orderpriority as title", "cast(o_custkey % 30 as int) as stage_id", "case when o_orderkey % 3 = 0 then cast(o_orderkey % 7 as int) end as reason_id", "cast(o_orderkey % 25 as int) as type_id", "cast(o_custkey % 5 as int) as space_id", "cast(o_custkey % 27 as int) as path_id", "case when o_orderkey % 10 < 3 then o_orderkey % 10 = 0 end as is_deleted", "o_orderdate as submitted"]),
    "stages": ("nation", ["n_nationkey as stage_id", "n_name as name"]),
    "reasons": ("region", ["r_regionkey as reason_id", "r_name as name", "substr(r_name, 1, 2) as code"]),
    "types": ("nation", ["n_nationkey as type_id", "n_regionkey as space_id", "'Type ' || n_name as name"]),
    "paths": ("nation", ["n_nationkey as path_id", "n_regionkey as journal_id", "case when n_nationkey % 4 > 0 then n_nationkey end as section_id"]),
    "journals": ("region", ["r_regionkey as journal_id", "r_name as name"]),
    "sections": ("nation", ["n_nationkey as section_id", "n_name as name"]),
    "authors": ("lineitem", ["l_orderkey as article_id", _AUTHOR, "case when l_partkey % 5 > 0 then 'P' || (l_partkey % 50) || ' ' end as first_name", "case when l_partkey % 3 = 0 then 'M' when l_partkey % 3 = 1 then '' end as middle_name", "case when l_partkey % 20 = 0 then 'N/A' else 'S' || l_suppkey end as last_name", "case when l_linenumber % 4 = 2 then true when l_linenumber % 4 = 1 then false end as is_submitting", "l_returnflag = 'R' as is_corresponding", "case when l_linenumber < 6 then l_linenumber end as {q}order{q}", "l_partkey as email_id"]),
    "emails": ("part", ["p_partkey as email_id", "p_partkey % 600 as user_id", "case when p_partkey % 11 > 0 then p_name || '@' || p_brand end as email", "p_size % 2 = 0 as is_primary", "p_size as modified"]),
    "affiliations": ("lineitem", [_AUTHOR, "cast(l_linenumber % 2 as int) as {q}order{q}", "(l_suppkey + l_linenumber) % 120 as organisation_id"]),
    "organisations": ("supplier", ["s_suppkey as organisation_id", "case when s_suppkey % 9 = 0 then ' Unknown' else s_name end as name"]),
    "users": ("customer", ["c_custkey % 600 as user_id", "case when c_custkey % 7 > 0 then ' C' || (c_custkey % 40) end as first_name", "case when c_custkey % 40 < 10 then 'M' end as middle_name", "case when c_custkey % 7 > 0 then c_mktsegment end as last_name", "c_custkey as modified"]),
    "editors": ("lineitem", ["l_orderkey as article_id", "l_partkey % 700 as user_id", "case when l_returnflag = 'A' then l_shipdate end as revoked", "case when l_linestatus = 'F' then 1 else 2 end as status"]),
    "reviewers": ("lineitem", ["l_orderkey as article_id", "l_suppkey * 6 as user_id", "case when l_returnflag = 'N' then l_shipdate end as ended", "cast(l_linenumber % 4 as int) as status"]),
}
#: Strings made of event times, in several spellings, and what isn't a time.
_DAY, _TIME = "substr(cast(ts as {text}), 1, 10)", "substr(cast(ts as {text}), 12, 8)"
SPELLED = f"case event_id % 9 when 0 then {_DAY} when 1 then concat({_DAY}, ' ', {_TIME}) when 2 then concat({_DAY}, 'T', {_TIME}, '+02:00') when 3 then concat({_DAY}, 'T', {_TIME}, 'Z') when 4 then 'n/a' when 5 then '2024-13-40' when 6 then concat({_DAY}, 'T', {_TIME}, '-05:30') when 7 then '01/02/2024 10:00' end"


def _star(spark, d) -> dict[str, DataFrame]:
    return {name: read(spark, d, table).selectExpr(*(c.format(q="`") for c in columns)) for name, (table, columns) in DERIVED.items()}


def _articles(spark, d, *columns: str) -> DataFrame:
    return read(spark, d, "articles_raw").where("article_id is not null").select("article_id", *columns).distinct()


def _stream(spark, d: str, name: str) -> DataFrame:
    """A test table as a stream of files: a folder of them, or one file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    one = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(read(spark, d, name).schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d) if one else reader.parquet(f"{d}/{name}.parquet")


def article_context(spark, d):
    """The context star: one row per article of the window, with author, editors and reviewers."""
    return context.article_context(_star(spark, d), STAR_AS_OF, STAR_DAYS)


def context_status(spark, d):
    """The part of the context that a status backfill takes."""
    return context.status_and_journal(article_context(spark, d))


def context_backfill(spark, d):
    """Author columns replaced by those of the author table; the address that the articles had stays, though the new table has one too."""
    a = _articles(spark, d, "author_email", "author_org", "author_ip", "journal")
    p = tables.primary_author(read(spark, d, "author_metadata"))
    return refresh.replace_columns(a, p.select("article_id", F.lower("email").alias("author_email"), F.col("organisation").alias("author_org"), F.col("ip_address").alias("author_ip")), "article_id", keep=("author_ip",))


def status_backfill(spark, d):
    """Status and journal of the articles as the latest version of their record has them."""
    a = _articles(spark, d, "stage_id", "stage_name", "journal", "section", "author_email")
    ids = read(spark, d, "resources").where("resource_type_definition_id = 1 and external_id is not null").select(F.col("id").alias("resource_id"), F.col("external_id").alias("article_id")).distinct()
    scalars = tables.model_scalars(tables.latest_versions(read(spark, d, "resource_version")))
    return refresh.replace_columns(a, ids.join(scalars, "resource_id").select("article_id", "stage_id", "stage_name", "journal", "section"), "article_id")


def title_backfill(spark, d):
    """Empty titles filled from the latest version of the record, cut to their greatest length."""
    a = _articles(spark, d, "article_title")
    ids = read(spark, d, "resources").where("resource_type_definition_id = 1 and external_id is not null").select(F.col("id").alias("resource_id"), F.col("external_id").alias("article_id")).distinct()
    scalars = tables.model_scalars(tables.latest_versions(read(spark, d, "resource_version")))
    new = ids.join(scalars, "resource_id").select("article_id", F.substring(clean(F.col("title")), 1, tables.TITLE_MAX).alias("article_title"))
    return refresh.fill_if_empty(a, new, "article_id", ("article_title",), lambda c: clean(c) == "")


def backfill_targets(spark, d):
    """Articles of which the author's name, e-mail, organisation or the title is empty."""
    columns = ("author_name", "author_email", "author_org", "article_title")
    return _articles(spark, d, *columns).where(refresh.needs_backfill(columns, lambda c: clean(c) == "")).select("article_id").distinct()


def title_scan(spark, d):
    """First title of the window's articles."""
    return tables.titles(read(spark, d, "articles_raw").where("article_id is not null"), tables.recent_articles(read(spark, d, "resources"), sourcing.AS_OF, sourcing.DAYS))


def conformed_articles(spark, d):
    """The assembled window in the fixed schema: missing columns null, in order."""
    return conform(sourcing.assembled_articles(spark, d), ARTICLES)


def conformed_refresh(spark, d):
    """The refreshed window of two sides that differ in columns and types, conformed while it is spliced."""
    cache, fresh = sourcing._cache_and_fresh(spark, d)
    cache = cache.withColumn("article_id", F.col("article_id").cast("string")).withColumn("extra", F.lit(1))
    merged, _ = refresh.splice(cache, fresh.drop("author_org"), "article_id", "created", sourcing.AS_OF, sourcing.DAYS, ARTICLES)
    return merged.select("article_id", "created", "author_name", "author_org", "journal", "article_title")


def conformed_archive(spark, d):
    """Aged rows appended to an archive of older columns, both conformed."""
    cache, fresh = sourcing._cache_and_fresh(spark, d)
    _, gone = refresh.splice(cache, fresh, "article_id", "created", sourcing.AS_OF, sourcing.DAYS)
    previous = refresh.aged(cache, "created", sourcing.AS_OF, sourcing.DAYS + 10).select(F.col("article_id").cast("string").alias("article_id"), "created", F.lit("old").alias("gone_column"))
    return refresh.archive(previous, gone, "article_id", ARTICLES).select("article_id", "created", "author_name", "journal")


def lenient_dates(spark, d):
    """Dates and naive times of strings in several spellings."""
    e = read(spark, d, "events").select("event_id", F.expr(SPELLED.format(text="string")).alias("text"))
    return e.select("event_id", lenient_date(F.col("text")).alias("day"), naive_utc(F.col("text")).alias("utc"))


def email_flags(spark, d):
    """Whether an author's address has letters, or nothing but digits, and the name without other characters."""
    a = _articles(spark, d, "author_email", "author_name")
    return a.select("article_id", local_part(F.col("author_email")).alias("local"), F.coalesce(has_letters(F.col("author_email")), F.lit(False)).alias("letters"), F.coalesce(digits_only(F.col("author_email")), F.lit(False)).alias("digits"), letters_and_digits(F.col("author_name")).alias("plain_name")).distinct()


def address_reuse(spark, d):
    """Articles, organisations, languages and time zones seen with each network address."""
    one = linkage._derived(spark, d, "article_id", "ip", "author_org", "locale").where("ip <> ''").withColumn("org", F.nullif("author_org", F.lit(""))).withColumn("loc", F.nullif("locale", F.lit("")))
    return one.groupBy("ip").agg(F.count("*").alias("n_articles"), F.count_distinct("org").alias("n_orgs"), F.count_distinct("loc").alias("n_locales"))


def enrich_lag(spark, d):
    """Days between an article and its latest fingerprint: number, mean and largest."""
    r = tables.recent_articles(read(spark, d, "resources"), sourcing.AS_OF, sourcing.DAYS)
    f = read(spark, d, "device_fingerprints").groupBy("article_id").agg(F.max("last_enrich_utc").alias("enriched"))
    lag = F.date_diff(F.to_date("enriched"), F.to_date("created"))
    return r.join(f, "article_id").select("article_id", lag.alias("lag")).where("lag is not null").distinct().agg(F.count("*").alias("n"), report.half_up(F.avg(F.abs("lag")), 4).alias("mean_days"), F.max("lag").alias("most_days"))


def feature_scores(spark, d):
    """What a match of one attribute alone is worth."""
    return report.feature_scores(spark)


def lift_order(spark, d):
    """Attributes of at least a hundred articles by falling lift."""
    return report.lift_order(linkage.type_lift(spark, d))


def smoke_peers(spark, d):
    """Best peers of the first two hundred articles; the peers are all articles."""
    index = linkage._index(spark, d)
    return pairs.peers_of(index, index.select("article_id").distinct().orderBy("article_id").limit(200))


def hub_neighbours(spark, d):
    """Hubs linked with the largest address hub."""
    index = linkage._index(spark, d)
    top = hubs.stats(index).where("attr = 'ip'").orderBy(F.desc("size"), "value").select("value").first()
    return hubs.neighbours(hubs.adjacency(index), "ip", top[0] if top else "")


def tracking_states(spark, d):
    """The latest state of each tracked key: of the events of a user, by time and then id."""
    return latest_row(read(spark, d, "events").where("user_id is not null"), ["user_id"], "ts", "event_id").select("user_id", F.col("event_type").alias("state"), F.col("ts").alias("since"))


def decoded_enums(spark, d):
    """Codes of the export turned back into names by their position; out of range is empty."""
    e = linkage.encoded_enums(spark, d)
    return e.select("article_id", messages.name_at(F.col("pm_band"), messages.BAND_CODE).alias("pm_band"), messages.name_at(F.col("wd_status"), messages.STATUS_CODE).alias("wd_status"), messages.name_at(F.col("email_pattern") + 1, messages.PATTERN_CODE).alias("next_pattern"))


def document_evidence(spark, d):
    """Y or N where the document's author was compared with the submitter."""
    a = linkage._derived(spark, d, "article_id", "wd_match", "wd_author")
    return a.select("article_id", "wd_author", F.when(F.col("wd_match"), "Y").when(~F.col("wd_match"), "N").otherwise("").alias("author_matches"))


def flag_ids(spark, d):
    """Whole-number keys of a flag store that also holds other keys."""
    key = F.when(F.col("status") == "removed", F.concat(F.lit("x"), F.col("article_id").cast("string"))).otherwise(F.col("article_id").cast("string"))
    return tables.flag_ids(read(spark, d, "flags").select(key.alias("row_key")), "row_key")


def sql_text(spark, d):
    """A SQL text over named tables."""
    text = "select r_name, count(*) as n_nations, max(n_name) as last_name from ligature_nation join ligature_region on n_regionkey = r_regionkey group by r_name"
    return tables.run_sql(spark, text, {"ligature_nation": read(spark, d, "nation"), "ligature_region": read(spark, d, "region")})


def table_listing(spark, d):
    """Names of the tables that the session knows under a prefix."""
    for t in ("nation", "region"):
        read(spark, d, t).createOrReplaceTempView(f"ligature_{t}")
    return spark.createDataFrame([(t,) for t in tables.list_tables(spark, "ligature_")], "name string").where("name in ('ligature_nation', 'ligature_region')")


def snapshot_roundtrip(spark, d):
    """The export as compressed JSON lines, read back: every hub with its members in order."""
    index = linkage._index(spark, d)
    folder = scratch(spark, "snapshot")
    sinks.export_snapshot(linkage._derived(spark, d, *tokens.INDEXED), index, hubs.stats(index), folder)
    articles, entries = sinks.load_snapshot(spark, folder, ("article_id long, author_name string", "attr string, value string, size long, article_ids array<long>"))
    known = articles.agg(F.count("*").alias("n_articles"))
    rows = entries.select("attr", "value", "size", F.array_join(F.transform("article_ids", lambda x: x.cast("string")), ",").alias("members"))
    return rows.withColumn("n_articles", F.lit(known.first()[0]))


def csv_roundtrip(spark, d):
    """Flag events with their place in the index, written as CSV with a header and read back."""
    path = scratch(spark, "flags")
    sinks.write_csv(linkage.flags_history(spark, d), path)
    return spark.read.schema("article_id long, status string, comment string, flagged_at timestamp_ntz, removed_at timestamp_ntz, flagged_by string, removed_by string, in_index boolean").option("header", True).csv(path).select("article_id", "status", F.nullif("comment", F.lit("")).alias("comment"), "flagged_at", "removed_at", "in_index")


def table_replaced(spark, d):
    """A table written, extended from itself and swapped, twice."""
    path = scratch(spark, "table")
    f = read(spark, d, "flags").select("article_id", "status")
    sinks.replace_table(f.where("status = 'active'"), path)
    sinks.replace_table(spark.read.parquet(path).unionByName(f.where("status = 'removed'")), path)
    return spark.read.parquet(path)


def outcomes_report(spark, d):
    """The report document of two aggregates, read back as rows."""
    text = sinks.report_json({"token_df_stats": report.df_stats(linkage.token_df(spark, d)).select("attr", "cap", "n_values"), "feature_scores": report.feature_scores(spark)})
    doc = spark.createDataFrame([(text,)], "doc string").select(F.from_json("doc", "token_df_stats array<struct<attr string, cap int, n_values long>>, feature_scores array<struct<attr string, score double>>").alias("d"))
    return doc.select(F.inline("d.token_df_stats"))


def mirror_stream(spark, d):
    """The events as a stream, upserted into a table: the latest event of each user."""
    events = read(spark, d, "events").select("event_id", "user_id", "ts", "event_type").where("user_id is not null")
    path = scratch(spark, "mirror")
    stream = _stream(spark, d, "events").select("event_id", "user_id", "ts", "event_type").where("user_id is not null")
    mirror.start_mirror(stream, f"{path}/table", f"{path}/state", "user_id", "ts", "event_id").awaitTermination()
    # Reconciling with the whole source changes nothing that the stream has got.
    mirror.reconcile(spark, events.where("event_type = 'error'"), f"{path}/table", "user_id", "ts", "event_id")
    return mirror.read_mirror(spark, f"{path}/table", events)


def stream_windows(spark, d):
    """Events of a stream per type and day: windowed counts, of each event once, as they stand when all is read."""
    path = scratch(spark, "windows")
    stream = _stream(spark, d, "events").where("ts is not null and event_id is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = mirror.windowed_counts(stream.select("ts", "event_type"), ["event_type"], "ts")
    sink = lambda batch, _: sinks.replace_table(batch, f"{path}/table")
    counted.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    like = spark.createDataFrame([], "start timestamp, event_type string, n long")
    return sinks.read_or_empty(spark, f"{path}/table", like).select(F.to_date("start").alias("day"), "event_type", "n")


def queries() -> dict:
    fs = (
        article_context, context_status, context_backfill, status_backfill, title_backfill, backfill_targets, title_scan, conformed_articles, conformed_refresh, conformed_archive, lenient_dates, email_flags, address_reuse, enrich_lag,
        feature_scores, lift_order, smoke_peers, hub_neighbours, tracking_states, decoded_enums, document_evidence, flag_ids, sql_text, table_listing, snapshot_roundtrip, csv_roundtrip, table_replaced, outcomes_report, mirror_stream, stream_windows,
    )
    return {f.__name__: f for f in fs}


def _context_sql() -> str:
    derived = ", ".join(f"{n} as (select {', '.join(c.format(q=chr(34)) for c in columns)} from {t})" for n, (t, columns) in DERIVED.items() if n not in ("articles", "authors", "emails"))
    own = {n: f"select {', '.join(c.format(q=chr(34)) for c in DERIVED[n][1])} from {DERIVED[n][0]}" for n in ("articles", "authors", "emails")}
    c = sql.clean
    full = "nullif(trim(regexp_replace(coalesce(first_name, '') || ' ' || coalesce(middle_name, '') || ' ' || coalesce(last_name, ''), ' +', ' ', 'g')), '')"
    shown = f"trim(concat_ws(' ', nullif(first_name, ''), nullif(middle_name, ''), nullif(last_name, '')), {sql.W})"

    def people(assigned: str, limit: int) -> str:
        return f"select article_id, string_agg(who, ',' order by who) as names from (select *, row_number() over (partition by article_id order by who) as rn from (select distinct article_id, coalesce({full}, email) as who from ({assigned}) left join lu using (user_id) left join pe using (user_id)) where who is not null) where rn <= {limit} group by 1"

    return f"""with {derived},
art as (select * from ({own["articles"]}) where not coalesce(is_deleted, false) and submitted >= timestamp '{STAR_AS_OF}' - interval {STAR_DAYS} day),
mail as ({own["emails"]}),
lu as (select * from (select *, row_number() over (partition by user_id order by modified desc nulls last, first_name nulls last, last_name nulls last, middle_name nulls last) as rn from users) where rn = 1),
pe as (select user_id, email from (select *, row_number() over (partition by user_id order by modified desc nulls last, email nulls last) as rn from mail where is_primary and user_id is not null) where rn = 1),
first_org as (select author_id, min(organisation_id) as organisation_id from affiliations where "order" = 1 group by 1),
aut as (select a.*, row_number() over (partition by article_id order by case when coalesce(is_submitting, false) then 0 else 1 end, case when coalesce(is_corresponding, false) then 0 else 1 end, "order" nulls last, author_id nulls last, first_name nulls last, middle_name nulls last, last_name nulls last, email_id nulls last) as rn from (select distinct * from ({own["authors"]})) a where article_id is not null),
who as (select article_id, {c(shown)} as author_name, lower({c("email")}) as author_email, {c("organisations.name")} as author_org from aut left join mail using (email_id) left join first_org using (author_id) left join organisations using (organisation_id) where rn = 1),
ed as ({people("select distinct article_id, user_id from editors where revoked is null and status = 1", context.EDITORS)}),
re as ({people("select distinct article_id, user_id from reviewers where status = 2 or (status = 1 and ended is null)", context.REVIEWERS)}),
ctx as (select distinct art.article_id, art.title, art.stage_id, stages.name as stage_name, reasons.name as rejection_reason, reasons.code as rejection_code, types.name as article_type, journals.name as journal, sections.name as section, author_name, author_email, author_org, ed.names as editors, re.names as reviewers
  from art left join stages using (stage_id) left join reasons using (reason_id) left join types on types.type_id = art.type_id and types.space_id = art.space_id left join paths using (path_id) left join journals on journals.journal_id = paths.journal_id left join sections on sections.section_id = paths.section_id
  left join who on who.article_id = art.article_id left join ed on ed.article_id = art.article_id left join re on re.article_id = art.article_id)
"""


def oracle_sql() -> dict[str, str]:
    u, c, w = sql.upto, sql.clean, sql.with_
    ranked = tokens.RANKED
    raw = lambda *cols: f"(select distinct article_id, {', '.join(cols)} from articles_raw where article_id is not null)"
    other = sourcing.oracle_sql()
    model = f"scal as ({other['model_scalars']}), ids as (select distinct id as resource_id, external_id as article_id from resources where resource_type_definition_id = 1 and external_id is not null), have as (select article_id, scal.* from ids join scal using (resource_id))"
    made = {"article_title": "cast(null as varchar)", **{n: "cast(null as varchar)" for n in ("rejection_reason", "rejection_code", "article_type", "editors", "reviewers")}, "stage_id": "cast(null as int)"}
    old = f"timestamp '{sourcing.AS_OF}' - interval {sourcing.DAYS} day"
    young = f"timestamp '{sourcing.AS_OF}' - interval {sourcing.REFRESH_DAYS} day"
    text = SPELLED.format(text="varchar")
    pools = {"b": messages.BAND_CODE, "s": messages.STATUS_CODE, "p": messages.PATTERN_CODE}
    named = lambda code, pool, by=0: "(case " + code + " " + " ".join(f"when {v - by} then '{k}'" for k, v in pools[pool].items()) + " else '' end)"
    top = "(select value from hub where attr = 'ip' order by size desc, value limit 1)"
    checks = {
        "context_backfill": w(sourcing.PRIMARY) + f"select a.article_id, author_ip, journal, lower(prim.email) as author_email, organisation as author_org from {raw('author_email', 'author_org', 'author_ip', 'journal')} a left join prim using (article_id)",
        "status_backfill": f"with {model} select a.article_id, author_email, have.stage_id, have.stage_name, have.journal, have.section from {raw('stage_id', 'stage_name', 'journal', 'section', 'author_email')} a left join have using (article_id)",
        "title_backfill": f"with {model} select a.article_id, case when {c('article_title')} = '' and have.article_id is not null then coalesce(left({c('title')}, 300), article_title) else article_title end as article_title from {raw('article_title')} a left join have using (article_id)",
        "backfill_targets": "select distinct article_id from articles_raw where article_id is not null and (" + " or ".join(f"{c(x)} = ''" for x in ("author_name", "author_email", "author_org", "article_title")) + ")",
        "title_scan": w(sourcing.RECENT) + "select article_id, min(article_title) as article_title from articles_raw where article_title is not null and article_id in (select article_id from recent) group by 1",
        "conformed_articles": f"with base as ({other['assembled_articles']}) select " + ", ".join(f"{made[n]} as {n}" if n in made else n for n in ARTICLES.names) + " from base",
        "conformed_refresh": w(sourcing.ART0) + f"select article_id, created, author_name, case when created >= {young} then null else author_org end as author_org, case when created >= {young} then journal else 'cached' end as journal, cast(null as varchar) as article_title from a where created >= {old}",
        "conformed_archive": w(sourcing.ART0) + f"select article_id, created, author_name, 'cached' as journal from a where created is null or created < {old}",
        "lenient_dates": f"""with t as (select event_id, {text} as text from events), d as (select *, regexp_matches(text, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') as there, case when regexp_matches(text, '[+-][0-9]{{2}}:[0-9]{{2}}$') then right(text, 6) end as zone from t)
select event_id, case when there then try_cast(left(text, 10) as date) end as day,
  case when there then try_cast(regexp_replace(text, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$', '') as timestamp) - to_minutes(case left(coalesce(zone, '+00:00'), 1) when '-' then -1 else 1 end * (cast(substr(coalesce(zone, '+00:00'), 2, 2) as int) * 60 + cast(right(coalesce(zone, '+00:00'), 2) as int))) end as utc from d""",
        "email_flags": "select distinct article_id, local, regexp_matches(local, '[a-zA-Z]') as letters, regexp_full_match(local, '[0-9]+') as digits, regexp_replace(lower(coalesce(author_name, '')), '[^a-z0-9]+', '', 'g') as plain_name from (select article_id, author_name, case when contains(coalesce(author_email, ''), '@') then split_part(author_email, '@', 1) else '' end as local from articles_raw where article_id is not null)",
        "address_reuse": u("art") + "select ip, count(*) as n_articles, count(distinct nullif(author_org, '')) as n_orgs, count(distinct nullif(locale, '')) as n_locales from art where ip <> '' group by 1",
        "enrich_lag": w(sourcing.RECENT) + "select count(*) as n, round(avg(abs(lag)), 4) as mean_days, max(lag) as most_days from (select distinct article_id, cast(date_diff('day', created, enriched) as int) as lag from recent join (select article_id, max(last_enrich_utc) as enriched from device_fingerprints group by 1) using (article_id)) where lag is not null",
        "feature_scores": "select * from (values " + ", ".join(f"('{a}', {float(x)}::double)" for a, (_, x) in ranked.items()) + ") t(attr, score)",
        "smoke_peers": u("pair") + f"select subject, peer, matched, score, cast(rank as int) as rank from (select *, row_number() over (partition by subject order by score desc, {sql.FIRST}, peer) as rank from side where score >= 3 and subject in (select article_id from (select distinct article_id from idx) order by 1 limit 200)) where rank <= 20",
        "hub_neighbours": u("hub") + f", e as (select y.attr, y.value, count(*) as shared from idx x join idx y on x.article_id = y.article_id and (x.attr, x.value) <> (y.attr, y.value) where x.attr = 'ip' and x.value = {top} and y.attr in ('device', 'ip', 'wd_author', 'wd_edited_by') group by 1, 2) select * from e",
        "tracking_states": "select user_id, event_type as state, ts as since from (select *, row_number() over (partition by user_id order by ts desc nulls last, event_id desc nulls last) as rn from events where user_id is not null) where rn = 1",
        "document_evidence": u("art") + "select article_id, wd_author, case when wd_match then 'Y' when not wd_match then 'N' else '' end as author_matches from art",
        "flag_ids": "select distinct article_id from flags where article_id is not null and coalesce(status, '') <> 'removed'",
        "sql_text": "select r_name, count(*) as n_nations, max(n_name) as last_name from nation join region on n_regionkey = r_regionkey group by r_name",
        "table_listing": "select * from (values ('ligature_nation'), ('ligature_region')) t(name)",
        "snapshot_roundtrip": u("hub") + "select attr, value, size, members, (select count(distinct article_id) from idx) as n_articles from hub join (select attr, value, string_agg(article_id, ',' order by article_id) as members from idx group by 1, 2) using (attr, value)",
        "csv_roundtrip": u("idx") + "select article_id, status, nullif(comment, '') as comment, flagged_at, removed_at, coalesce(article_id in (select article_id from idx), false) as in_index from flags",
        "table_replaced": "select article_id, status from flags where status in ('active', 'removed')",
        "outcomes_report": u("freq") + f"select attr, {sql.CAP} as cap, count(*) as n_values from freq group by 1, 2",
        "mirror_stream": "select event_id, user_id, ts, event_type from (select *, row_number() over (partition by user_id order by ts desc nulls last, event_id desc nulls last) as rn from events where user_id is not null) where rn = 1",
        "stream_windows": "select cast(ts as date) as day, event_type, count(*) as n from events where ts is not null and event_id is not null group by 1, 2",
        "decoded_enums": f"with e as ({linkage.oracle_sql()['encoded_enums']}) select article_id, {named('pm_band', 'b')} as pm_band, {named('wd_status', 's')} as wd_status, {named('email_pattern', 'p', 1)} as next_pattern from e",
        "lift_order": f"with l as ({linkage.oracle_sql()['type_lift']}) select cast(row_number() over (order by coalesce(lift, 0) desc, attr) as int) as place, attr, lift, weight from l where n >= 100",
        "article_context": _context_sql() + "select * from ctx",
        "context_status": _context_sql() + "select article_id, stage_id, stage_name, journal, section, article_type from ctx",
    }
    done = ("article_context", "context_status", "decoded_enums", "lift_order", "title_backfill", "status_backfill", "conformed_articles")
    return {name: text if name in done else sql.half_up(text) for name, text in checks.items()}
