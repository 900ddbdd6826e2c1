"""The queries p3 and p4: general operators for training data that live in the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ligature.operators import nested
from ligature.operators.bursts import bursts
from ligature.plans import sql
from ligature.runtime import read

BURST_ATTRS = ("asn_hash", "ip_hash", "timezone")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author and affiliation nodes of every record."""
    return nested.positions(read(spark, sf_dir, "resource_version"))


def p3_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The author table."""
    return nested.subtype(nested.flatten(read(spark, sf_dir, "resource_version")), "author").drop("shape", "extra").distinct()


def p3_affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affiliation table, primary ones and plain strings included."""
    return nested.subtype(nested.flatten(read(spark, sf_dir, "resource_version")), "affiliation").drop("shape", "extra").distinct()


def p3_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects under members that no variant knows, with their parents' keys, and what else no column takes, of the whole record."""
    nodes = nested.flatten(read(spark, sf_dir, "resource_version"), outer=True)
    return nodes.where("extra is not null").select("version_id", "author_pos", "node", "affil_pos", "item_pos", "shape", "name", "extra").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of activity of every network, address and time zone."""
    return bursts(read(spark, sf_dir, "device_fingerprints"), BURST_ATTRS).select("attr_name", "key_value", "first_id")


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_authors, p3_affiliations, p3_unknown, p4_found)}


def _norm(column: str) -> str:
    value = f"lower(trim({column}, ' ' || chr(9)))"
    return f"case when {value} in ('', 'na', 'n/a', 'none', 'nan', 'null', 'unknown', '-') then null else {value} end"


def oracle_sql() -> dict[str, str]:
    keyed = " union all ".join(f"select '{a}' as attr_name, {_norm(a)} as key_value, ts, id from once" for a in BURST_ATTRS)
    text = lambda m: f"json_extract_string(e, '$.{m}')"
    flag = lambda m: f"case json_type(json_extract(e, '$.{m}')) when 'BOOLEAN' then cast(json_extract_string(e, '$.{m}') as boolean) end"
    place = ", ".join(f"{text(m)} as {n}" for m, n in (("name", "name"), ("organisationName", "organisation"), ("address.city", "city"), ("address.countryCode", "country_code")))
    bare = "json_extract_string(e, '$') as name, null as organisation, null as city, null as country_code"
    return {
        "p3_found": f"""{sql.JSON_AUTHORS}
select distinct id as version_id, author_pos, 'author' as node, -1 as affil_pos from o
union select id, author_pos, 'primary', -1 from o where json_type(json_extract(e, '$.primaryAffiliation')) = 'OBJECT'
union select id, author_pos, 'affiliation', affil_pos from g where json_type(e) = 'OBJECT'
""",
        "p3_authors": f"""{sql.JSON_AUTHORS}
select distinct id as version_id, author_pos, {", ".join(f"{text(m)} as {n}" for m, n in (("fullName", "full_name"), ("firstName", "first_name"), ("middleName", "middle_name"), ("lastName", "last_name"), ("primaryEmail", "primary_email"), ("email", "email")))}, {flag("isSubmittingAuthor")} as is_submitting, {flag("isCorrespondingAuthor")} as is_corresponding from o
""",
        "p3_affiliations": f"""{sql.JSON_AUTHORS},
p as (select id, author_pos, json_extract(e, '$.primaryAffiliation') as e from o),
t as (select id, author_pos, json_extract(e, '$.affiliations') as e from o)
select distinct id as version_id, author_pos, 'primary' as node, -1 as affil_pos, {place} from p where json_type(e) = 'OBJECT'
union select id, author_pos, 'affiliation', affil_pos, {place} from g where json_type(e) = 'OBJECT'
union select id, author_pos, 'primary_text', -1, {bare} from p where json_type(e) = 'VARCHAR'
union select id, author_pos, 'affiliation_text', affil_pos, {bare} from g where json_type(e) = 'VARCHAR'
union select id, author_pos, 'affiliation_text', 0, {bare} from t where json_type(e) = 'VARCHAR'
""",
        "p4_found": f"""
with once as (
  select * from (select id, last_enrich_utc as ts, asn_hash, ip_hash, timezone, row_number() over (partition by id order by last_enrich_utc, {", ".join(f"{_norm(a)} nulls first" for a in BURST_ATTRS)}) as rn
    from device_fingerprints where id is not null and last_enrich_utc is not null) where rn = 1
),
keyed as (select * from ({keyed}) where key_value is not null),
gaps as (select *, case when ts - lag(ts) over w <= interval 10 minute then 0 else 1 end as new_run from keyed window w as (partition by attr_name, key_value order by ts, id)),
runs as (select *, sum(new_run) over (partition by attr_name, key_value order by ts, id rows unbounded preceding) as run from gaps)
select attr_name, key_value, first(id order by ts, id) as first_id from runs group by attr_name, key_value, run having count(*) >= 4
""",
    }
