"""Articles as searchable tokens: derive, unpivot, drop what is generic or too common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligature.functions import messages
from ligature.functions.profile import profile_errors, profile_key, token_of_key
from ligature.functions.text import email_pattern, strip, unblank
from ligature.runtime import cut, small

#: Indexed attributes and the largest number of articles that may share a value.
CAPS = {"email": 120, "ip": 120, "device": 120, "author_ip": 120, "wd_author": 500, "wd_edited_by": 500, "wd_company": 500, "locale": 25}
#: Attributes that are compared in pairs: bit, weight. The order decides ties.
RANKED = {"device": (1, 10), "ip": (2, 8), "wd_author": (4, 8), "wd_edited_by": (8, 8), "wd_company": (16, 6), "locale": (32, 1)}
DECISION, NET, DOC = 15, 3, 12
WEAK = ("locale",)
DOCUMENT = ("wd_author", "wd_edited_by", "wd_company")
# Names that document software and computers fill in by themselves.
GENERIC = (
    "administrator", "admin", "windows user", "user", "microsoft", "microsoft office user",
    "microsoft office", "dell", "hp", "lenovo", "acer", "asus", "pc", "author", "default",
    "guest", "owner", "windows", "toshiba", "samsung", "office", "hpuser", "administrateur",
    "usuario", "utente", "windows 用户", "用户", "administrator1", "1", "123",
    "python-docx", "un-named", "unnamed", "apache poi", "microsoft account",
)
TITLE_LENGTH, HASH_LENGTH = 60, 16


def derive(articles: DataFrame, strict_profile: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per article with its display, score and token columns; empty string where there is nothing.

    Rows repeated whole count once; rows without article_id are dropped. Every expression is native.
    ``keep`` names the columns wanted, so that only what they need is read and compared.
    """
    wd, pm = F.col("wd_message"), F.col("pm_message")
    plain = ("author_name", "author_org", "stage_name", "journal", "section", "article_type", "editors", "reviewers", "platform", "ua_family")
    # Each value is stripped once, cleaned once and then used: the steps keep Catalyst from repeating an expression.
    stripped = articles.where("article_id is not null").select(
        "article_id", F.to_date("created").alias("created_on"), *(strip(F.col(c)).alias(c) for c in (*plain, "article_title", "author_email", "ip_hash", "author_ip", "languages", "timezone", "asn_hash")),
        messages.raw_field(wd, "Author").alias("wd_author"), messages.raw_field(wd, "Last modified by").alias("wd_edited_by"), messages.raw_field(wd, "Company").alias("wd_company"),
        messages.risk_score(pm).alias("pm_score"), messages.risk_band(pm).alias("pm_band"), messages.status_name(F.col("wd_status")).alias("wd_status"), messages.document_match(wd).alias("wd_match"),
        (F.when(F.size(profile_errors()) == 0, profile_key()).otherwise("") if strict_profile else profile_key()).alias("_key"), F.lit(None).cast("string").alias("device_id") if strict_profile else F.col("device_id"),
    )
    cleaned = stripped.withColumns({c: unblank(F.col(c)) for c in (*plain, "author_ip", "languages", "timezone", "wd_author", "wd_edited_by", "wd_company")}).withColumns({"email": F.lower(unblank(F.col("author_email"))), "ip": unblank(F.col("ip_hash")), "asn": unblank(F.col("asn_hash")), "title": unblank(F.col("article_title"))})
    out = cleaned.select(
        "article_id", "created_on", F.substring("title", 1, TITLE_LENGTH).alias("title"), *plain, "pm_score", "pm_band", "wd_status", "wd_match",
        email_pattern(F.col("email")).alias("email_pattern"), "email", F.substring("ip", 1, HASH_LENGTH).alias("ip"), token_of_key("_key", "device_id").alias("device"), "author_ip", "wd_author", "wd_edited_by", "wd_company",
        F.when((F.col("languages") != "") & (F.col("timezone") != ""), F.concat_ws("|", "languages", "timezone")).otherwise("").alias("locale"), "asn",
    )
    return (out.select(*keep) if keep else out).distinct()


#: Columns that the index needs.
INDEXED = ("article_id", *CAPS, "author_name", "author_org", "created_on", "wd_status")


def unpivot(derived: DataFrame, attrs: tuple[str, ...] = tuple(CAPS), carry: tuple[str, ...] = ()) -> DataFrame:
    """``(attr, value, article_id, <carry>)`` of every non-empty value; generic document values are dropped."""
    pairs = F.array(*(F.struct(F.lit(a).alias("attr"), F.col(a).alias("value")) for a in attrs))
    rows = derived.select("article_id", *carry, F.explode(pairs).alias("_p")).select("_p.attr", "_p.value", "article_id", *carry)
    return rows.where((F.col("value") != "") & ~(F.col("attr").isin(*DOCUMENT) & F.lower("value").isin(*GENERIC)))


def frequencies(toks: DataFrame) -> DataFrame:
    """Number of articles per (attr, value); partial sums before the shuffle."""
    return toks.groupBy("attr", "value").agg(F.count("*").alias("df"))


def cap_of(caps: dict[str, int]):
    table = F.create_map(*(x for k, v in caps.items() for x in (F.lit(k), F.lit(v))))
    return table[F.col("attr")]


def kept(toks: DataFrame, caps: dict[str, int] = CAPS, least: int = 2) -> DataFrame:
    """Tokens whose value is shared by at least ``least`` articles and at most the attribute's cap.

    The frequencies that survive are joined back; values above the cap leave before any join on
    values, so a value that many articles share costs one counter.
    """
    inside = frequencies(toks).where((F.col("df") >= least) & (F.col("df") <= cap_of(caps)))
    return toks.join(inside, ["attr", "value"])


def connected(kept_tokens: DataFrame) -> DataFrame:
    """Articles that hold a kept value of an attribute that isn't weak."""
    return kept_tokens.where(~F.col("attr").isin(*WEAK)).select("article_id").distinct()


def index(derived: DataFrame, caps: dict[str, int] = CAPS, carry: tuple[str, ...] = ("author_name", "author_org", "created_on", "wd_status")) -> DataFrame:
    """The kept tokens of connected articles, of values that still have two of them."""
    # Tokens are written once: deriving them costs more than reading them back for the count and the join.
    own = cut(kept(cut(unpivot(derived, carry=carry)), caps))
    # All holders of a kept strong value are connected by it, so only weak values can lose some.
    strong = own.where(~F.col("attr").isin(*WEAK)).withColumnRenamed("df", "size")
    weak = own.where(F.col("attr").isin(*WEAK)).drop("df").join(connected(own), "article_id", "left_semi")
    left = kept(weak, {a: 1 << 30 for a in caps}).withColumnRenamed("df", "size")
    return strong.unionByName(left)


def flagged(flags: DataFrame) -> DataFrame:
    """Articles whose latest flag event is active; null ids are left out."""
    when = F.coalesce("removed_at", "flagged_at")
    last = flags.where("article_id is not null").groupBy("article_id").agg(F.max_by("status", F.struct(when, "status")).alias("status"))
    return last.where(F.lower("status") == "active").select("article_id")


def small_flags(flags: DataFrame) -> DataFrame:
    """Active flags, broadcast while the table is small."""
    return small(flagged(flags))
