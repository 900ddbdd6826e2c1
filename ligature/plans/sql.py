"""Pieces of DuckDB SQL that several checks share. They restate the definitions independently of the Spark plans."""

from __future__ import annotations

from ligature.functions.messages import STATUS
from ligature.functions.text import BLANKS, SPACE
from ligature.operators.tokens import CAPS, GENERIC, RANKED

W = " || ".join(f"chr({ord(c)})" for c in SPACE)
BLANK_LIST = ", ".join(f"'{b}'" for b in BLANKS)


def clean(x: str) -> str:
    return f"(case when {x} is null or lower(trim({x}, {W})) in ({BLANK_LIST}) then '' else trim({x}, {W}) end)"


def normal(x: str) -> str:
    v = f"lower(trim({x}, ' ' || chr(9)))"
    return f"(case when {v} in ({BLANK_LIST}) then null else {v} end)"


def part(x: str) -> str:
    return f"coalesce(trim({x}, {W}), '')"


def pattern(email: str) -> str:
    local = f"lower(split_part({email}, '@', 1))"
    return f"(case when not contains({email}, '@') or {local} = '' then '' when regexp_full_match({local}, '[0-9]+') then 'all-digits' when regexp_full_match({local}, '[a-z]+\\.[a-z]+') then 'name.surname' when regexp_full_match({local}, '[a-z]+') then 'all-alpha' when regexp_matches({local}, '[a-z]') and regexp_matches({local}, '[0-9]') then 'alpha+digits' else 'other' end)"


def field(label: str) -> str:
    return clean(f"regexp_extract(wd_message, '{label}:\\s*(.*?)\\s*</li>', 1, 'is')")


_AROUND = "chr(65279) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


def _unwrap(j: str) -> str:
    return f"case when json_type({j}) = 'VARCHAR' then try_cast(trim(json_extract_string({j}, '$'), {_AROUND}) as json) else {j} end"


def _items(j: str) -> str:
    return f"case json_type({j}) when 'ARRAY' then cast({j} as json[]) when 'OBJECT' then [{j}] else cast([] as json[]) end"


#: ``o``: the author objects of each record; ``g``: the elements of their affiliations.
JSON_AUTHORS = f"""with v as (select distinct id, try_cast(trim(resource_model, {_AROUND}) as json) as j from resource_version where id is not null),
r as (select id, {_unwrap("j")} as j from v),
s as (select id, json_extract(j, '$.submission') as s from r where json_type(j) = 'OBJECT'),
u as (select id, {_unwrap("s")} as s from s),
a as (select id, json_extract(s, '$.authors') as a from u where json_type(s) = 'OBJECT'),
l as (select id, {_items("a")} as l from a),
e as (select id, cast(i - 1 as int) as author_pos, l[i] as e from (select id, l, unnest(range(1, len(l) + 1)) as i from l)),
o as (select * from e where json_type(e) = 'OBJECT'),
f as (select id, author_pos, {_items("json_extract(e, '$.affiliations')")} as l from o),
g as (select id, author_pos, cast(i - 1 as int) as affil_pos, l[i] as e from (select id, author_pos, l, unnest(range(1, len(l) + 1)) as i from f))"""
_text = lambda m, e="e": f"json_extract_string({e}, '$.{m}')"
_joined = f"trim(concat_ws(' ', nullif({_text('firstName')}, ''), nullif({_text('middleName')}, ''), nullif({_text('lastName')}, '')), {W})"
JSON_NAMED = f"""first_ as (select id, author_pos, coalesce(nullif({_text("name")}, ''), nullif({_text("organisationName")}, '')) as first_org from g where affil_pos = 0 and json_type(e) = 'OBJECT'),
named as (select id, author_pos, case when coalesce({_text("fullName")}, '') <> '' then trim({_text("fullName")}, {W}) else {_joined} end as name, coalesce(nullif({_text("primaryEmail")}, ''), nullif({_text("email")}, '')) as email,
  coalesce({_text("isSubmittingAuthor")} = 'true', false) as s, coalesce(json_type(json_extract(e, '$.primaryAffiliation')) = 'OBJECT', false) as has_primary,
  coalesce(nullif({_text("primaryAffiliation.organisationName")}, ''), nullif({_text("primaryAffiliation.name")}, '')) as primary_org, first_org from o left join first_ using (id, author_pos))"""

KEY = f"({part('canvas_hash')} || '|' || {part('webgl_hash')} || '|' || {part('hw_id_hash')} || '|' || {part('ua_family_hash')} || '|' || {part('platform')} || '|' || (case when screen_width is not null and screen_height is not null then screen_width || 'x' || screen_height else '' end) || '|' || coalesce(format('{{:g}}', device_pixel_ratio), ''))"
DEVICE = f"(case when not regexp_full_match({KEY}, '\\|*') then left(sha256({KEY}), 16) when regexp_full_match({part('device_id')}, '[a-f0-9]{{64}}') then left({part('device_id')}, 16) else '' end)"
EMAIL = f"lower({clean('author_email')})"
STATUS_NAME = "(case wd_status " + " ".join(f"when {k} then '{v}'" for k, v in STATUS.items()) + " else '' end)"
LOCALE = f"(case when {clean('languages')} <> '' and {clean('timezone')} <> '' then {clean('languages')} || '|' || {clean('timezone')} else '' end)"

ART = f"""art as (
  select distinct article_id, cast(created as date) as created_on, left({clean("article_title")}, 60) as title,
    {", ".join(f"{clean(c)} as {c}" for c in ("author_name", "author_org", "stage_name", "journal", "section", "article_type", "editors", "reviewers", "platform", "ua_family"))},
    try_cast(nullif(regexp_extract(pm_message, 'risk:\\s*([0-9.]+)\\s*%', 1, 'i'), '') as double) as pm_score,
    coalesce(lower(regexp_extract(pm_message, '(low|medium|high)\\s+risk', 1, 'i')), '') as pm_band,
    {STATUS_NAME} as wd_status,
    case when contains(lower(wd_message), 'does not match') then false when contains(lower(wd_message), 'matches the author') then true end as wd_match,
    {pattern(EMAIL)} as email_pattern, {EMAIL} as email, left({clean("ip_hash")}, 16) as ip, {DEVICE} as device, {clean("author_ip")} as author_ip,
    {field("Author")} as wd_author, {field("Last modified by")} as wd_edited_by, {field("Company")} as wd_company, {LOCALE} as locale, {clean("asn_hash")} as asn
  from articles_raw where article_id is not null
)"""
GENERIC_LIST = ", ".join(f"'{g}'" for g in GENERIC)
_TOK = " union all ".join(f"select article_id, '{a}' as attr, {a} as value from art where {a} <> ''" for a in CAPS)
CAP = "(case attr " + " ".join(f"when '{a}' then {c}" for a, c in CAPS.items()) + " end)"
TOK = f"tok as (select * from ({_TOK}) where not (attr in ('wd_author', 'wd_edited_by', 'wd_company') and lower(value) in ({GENERIC_LIST})))"
FREQ = "freq as (select attr, value, count(*) as df from tok group by 1, 2)"
KEPT = f"kept as (select tok.* from tok join freq using (attr, value) where df between 2 and {CAP})"
ALIVE = "alive as (select distinct article_id from kept where attr <> 'locale')"
IDX = """own as (select kept.* from kept join alive using (article_id)),
idx as (select o.attr, o.value, o.article_id, s.size, art.author_name, art.author_org, art.created_on
  from own o join (select attr, value, count(*) as size from own group by 1, 2 having count(*) >= 2) s using (attr, value) join art using (article_id))"""
HUBS = "hub as (select attr, value, count(*) as size, count(distinct nullif(author_name, '')) as n_authors, count(distinct nullif(author_org, '')) as n_orgs from idx group by 1, 2)"
BIT = "(case attr " + " ".join(f"when '{a}' then {b}" for a, (b, _) in RANKED.items()) + " else 0 end)"
RANKED_LIST = ", ".join(f"'{a}'" for a in RANKED)
SCORE = (
    "(" + " + ".join(f"(case when matched & {b} > 0 then {w}.0 else 0.0 end)" for b, w in RANKED.values())
    + " + (case when abs(datediff('day', created_a, created_b)) <= 7 then 1.0 when abs(datediff('day', created_a, created_b)) <= 30 then 0.5 else 0.0 end)"
    + " + (case when org_a <> '' and org_b <> '' and matched & 15 > 0 then (case when org_a <> org_b then 2.0 when matched & 3 > 0 then -2.0 else 0.0 end) else 0.0 end)"
    + " + (case when matched & 3 > 0 and matched & 12 > 0 then 4.0 else 0.0 end))"
)
PAIRS = f"""met as (select x.article_id as a, y.article_id as b, x.created_on as created_a, y.created_on as created_b, x.author_org as org_a, y.author_org as org_b,
    bit_or(case x.attr {" ".join(f"when '{a}' then {b}" for a, (b, _) in RANKED.items())} end) as matched
  from idx x join idx y on x.attr = y.attr and x.value = y.value and x.article_id < y.article_id where x.attr in ({RANKED_LIST}) group by 1, 2, 3, 4, 5, 6),
pair as (select a, b, matched, cast({SCORE} as double) as score from met),
side as (select a as subject, b as peer, matched, score from pair union all select b, a, matched, score from pair)"""
FIRST = "(case " + " ".join(f"when matched & {b} > 0 then {k}" for k, (b, _) in enumerate(RANKED.values())) + " else 6 end)"
COUNTS = "counts as (select subject as article_id, count(*) filter (where score >= 3) as n_peers, coalesce(max(score) filter (where score >= 3), 0.0) as max_score, count(*) as n_all, max(score) as max_all from side group by 1)"
PASSED = f"""ok as (select attr, value from hub where attr in ('device', 'ip', 'wd_author', 'wd_edited_by') and size >= 5 and n_authors >= 2 and n_orgs >= 2 and size <= {CAP}),
share as (select attr, value, author_name, count(*) as n, count(*) * 1.0 / max(size) as share from idx where author_name <> '' group by 1, 2, 3),
passed as (select idx.article_id, attr, value from idx join ok using (attr, value) left join share using (attr, value, author_name) where coalesce(share, 0) <= 0.5),
labels0 as (select article_id, bit_or({BIT}) as passed from passed group by 1)"""
FLAGS = "flag as (select article_id from (select article_id, arg_max(status, (coalesce(removed_at, flagged_at), status)) as status from flags where article_id is not null group by 1) where lower(status) = 'active')"
LABELS = """lab as (select al.article_id, coalesce(max_all, 0.0) as max_all, coalesce(n_all, 0) as n_all, coalesce(passed = 15, false) as b0, coalesce(bit_count(passed) >= 3, false) as near,
    coalesce(passed & 3 > 0 and passed & 12 > 0, false) as net_doc, coalesce(bit_count(passed) >= 3 or (passed & 3 > 0 and passed & 12 > 0), false) as structural, art.wd_status = 'red' as red, coalesce(bit_count(passed), 0) >= 1 as any_hub
  from (select distinct article_id from idx) al join art using (article_id) left join counts using (article_id) left join labels0 using (article_id))"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",\n".join(parts) + "\n"


def upto(what: str) -> str:
    """The WITH clause as far as one of its steps."""
    steps = [("art", ART), ("tok", TOK), ("freq", FREQ), ("kept", KEPT), ("alive", ALIVE), ("idx", IDX), ("hub", HUBS), ("pair", PAIRS), ("counts", COUNTS), ("passed", PASSED), ("flag", FLAGS), ("lab", LABELS)]
    names = [n for n, _ in steps]
    return with_(*(s for _, s in steps[: names.index(what) + 1]))


def half_up(text: str) -> str:
    """``text`` with every ``round(x, d)`` as one multiplication and one floor, as the Spark plans round."""
    while (at := text.find("round(")) >= 0:
        depth, i, comma = 1, at + 6, -1
        while depth:
            c = text[i]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = i
            i += 1
        scale = 10 ** int(text[comma + 1 : i - 1])
        text = f"{text[:at]}(floor(cast({text[at + 6 : comma]} as double) * {scale}.0 + 0.5) / {scale}.0){text[i:]}"
    return text
