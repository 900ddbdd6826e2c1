"""The editorial context of articles: a star over the warehouse tables, one row per article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligature.functions.text import clean, display_name, full_name
from ligature.operators.latest import best_row, ordered_list
from ligature.operators.refresh import within
from ligature.runtime import small

#: Columns of the result, whatever is missing.
COLUMNS = ("article_id", "title", "stage_id", "stage_name", "rejection_reason", "rejection_code", "article_type", "journal", "section", "author_name", "author_email", "author_org", "editors", "reviewers")
EDITORS, REVIEWERS = 3, 5


def latest_users(users: DataFrame) -> DataFrame:
    """The last state of each user in a change stream."""
    order = [F.desc_nulls_last("modified"), F.asc_nulls_last("first_name"), F.asc_nulls_last("last_name"), F.asc_nulls_last("middle_name")]
    return best_row(users.select("user_id", "first_name", "middle_name", "last_name", "modified").distinct(), ["user_id"], order).drop("modified")


def primary_emails(emails: DataFrame) -> DataFrame:
    """The last primary address of each user."""
    own = emails.where("is_primary and user_id is not null").select("user_id", "email", "modified").distinct()
    return best_row(own, ["user_id"], [F.desc_nulls_last("modified"), F.asc_nulls_last("email")]).drop("modified")


def picked_author(authors: DataFrame, emails: DataFrame, affiliations: DataFrame, organisations: DataFrame) -> DataFrame:
    """Per article the submitting, else the corresponding, else the first author, with e-mail and first organisation.

    The author is picked before anything is joined; the first affiliation is part of the join's
    condition, so an author without one stays. Ties are broken by the columns, null ones last.
    """
    rank = [F.when(F.coalesce("is_submitting", F.lit(False)), 0).otherwise(1), F.when(F.coalesce("is_corresponding", F.lit(False)), 0).otherwise(1), *(F.asc_nulls_last(c) for c in ("order", "author_id", "first_name", "middle_name", "last_name", "email_id"))]
    one = best_row(authors.where("article_id is not null").distinct(), ["article_id"], rank)
    first = affiliations.where(F.col("order") == 1).groupBy("author_id").agg(F.min("organisation_id").alias("organisation_id"))
    rows = one.join(emails.select("email_id", "email"), "email_id", "left").join(first, "author_id", "left").join(small(organisations.select("organisation_id", F.col("name").alias("org"))), "organisation_id", "left")
    name = display_name(F.col("first_name"), F.col("middle_name"), F.col("last_name"))
    return rows.select("article_id", clean(name).alias("author_name"), F.lower(clean(F.col("email"))).alias("author_email"), clean(F.col("org")).alias("author_org"))


def people(assigned: DataFrame, users: DataFrame, emails: DataFrame, limit: int, name: str) -> DataFrame:
    """The first names in order of each article's people: the full name, else the address."""
    rows = assigned.select("article_id", "user_id").distinct().join(latest_users(users), "user_id", "left").join(primary_emails(emails), "user_id", "left")
    return ordered_list(rows, ["article_id"], F.coalesce(full_name(F.col("first_name"), F.col("middle_name"), F.col("last_name")), F.col("email")), limit, name)


def article_context(t: dict[str, DataFrame], as_of: str, days: int) -> DataFrame:
    """One row per article of the window that isn't deleted, with stage, rejection, type, journal, section, author, editors and reviewers.

    ``t`` holds articles, stages, reasons, types, paths, journals, sections, authors, emails,
    affiliations, organisations, users, editors and reviewers. Dimensions are broadcast while they are
    small. What has no match is null; an empty table of articles gives no rows.
    """
    articles = within(t["articles"].where(~F.coalesce("is_deleted", F.lit(False))), "submitted", as_of, days)
    wanted = articles.select("article_id").distinct()
    own = lambda name: t[name].join(wanted, "article_id", "left_semi")
    named = lambda name, key, out: small(t[name].select(key, F.col("name").alias(out)))
    editors = own("editors").where("revoked is null and status = 1")
    reviewers = own("reviewers").where("status in (1, 2) and (status = 2 or ended is null)")
    star = (
        articles.join(named("stages", "stage_id", "stage_name"), "stage_id", "left")
        .join(small(t["reasons"].select("reason_id", F.col("name").alias("rejection_reason"), F.col("code").alias("rejection_code"))), "reason_id", "left")
        .join(small(t["types"].select("type_id", "space_id", F.col("name").alias("article_type"))), ["type_id", "space_id"], "left")
        .join(small(t["paths"].select("path_id", "journal_id", "section_id")), "path_id", "left")
        .join(named("journals", "journal_id", "journal"), "journal_id", "left")
        .join(named("sections", "section_id", "section"), "section_id", "left")
        .join(picked_author(own("authors"), t["emails"], t["affiliations"], t["organisations"]), "article_id", "left")
        .join(people(editors, t["users"], t["emails"], EDITORS, "editors"), "article_id", "left")
        .join(people(reviewers, t["users"], t["emails"], REVIEWERS, "reviewers"), "article_id", "left")
    )
    return star.select(*COLUMNS).distinct()


def status_and_journal(context: DataFrame) -> DataFrame:
    """The part of the context that the status backfill takes."""
    return context.select("article_id", "stage_id", "stage_name", "journal", "section", "article_type")
