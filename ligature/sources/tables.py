"""Sources: connection strings, JDBC, files, flags and SQL text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligature.operators.latest import best_row, first_non_null, latest_row
from ligature.operators.refresh import within
from ligature.schema import FINGERPRINT

# Spellings of the keys of a connection string.
KEYS = {"server": "server", "data source": "server", "address": "server", "addr": "server", "database": "database", "initial catalog": "database", "user id": "user", "uid": "user", "user": "user", "username": "user", "password": "password", "pwd": "password"}
QUERY_SECONDS, LOGIN_SECONDS = 600, 30
DOCUMENT, RISK = 75, 80
ARTICLE = 1


def parse_connection(text: str, default_database: str = "") -> dict[str, str]:
    """``key=value;`` pairs by lower-case key, aliases resolved; unknown keys stay, the database has a default."""
    pairs = (p.split("=", 1) for p in text.split(";") if "=" in p)
    out = {KEYS.get(k.strip().lower(), k.strip().lower()): v.strip() for k, v in pairs}
    if default_database:
        out.setdefault("database", default_database)
    return out


def jdbc(spark: SparkSession, connection: str, query: str, partition: tuple[str, int, int, int] | None = None):
    """A reader for one query; ``partition`` = (column, lower, upper, number) splits it over executors. Nothing is read yet."""
    c = parse_connection(connection)
    server = re.sub(r"^tcp:", "", c.get("server", "")).replace(",", ":")
    options = {"url": f"jdbc:sqlserver://{server};databaseName={c.get('database', '')};loginTimeout={LOGIN_SECONDS}", "user": c.get("user", ""), "password": c.get("password", ""), "queryTimeout": str(QUERY_SECONDS)}
    if partition:
        column, low, high, n = partition
        options |= {"dbtable": f"({query}) q", "partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(n)}
    else:
        options["query"] = query
    return spark.read.format("jdbc").options(**options)


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of a SQL text over the given tables, registered as temporary views."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


def flag_ids(rows: DataFrame, key: str) -> DataFrame:
    """Distinct numeric keys of a key-value flag store; keys that aren't whole numbers are left out."""
    return rows.select(F.expr(f"try_cast(`{key}` as bigint)").alias("article_id")).where("article_id is not null").distinct()


def list_tables(spark: SparkSession, prefix: str = "") -> list[str]:
    """Names of the tables and views the session knows, in order."""
    return sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(prefix))


def titles(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """``(article_id, article_title)``: the first title of each wanted article that isn't null, in their order."""
    own = rows.join(articles.select("article_id").distinct(), "article_id", "left_semi").where("article_title is not null")
    return own.groupBy("article_id").agg(F.min("article_title").alias("article_title"))


#: Longest title that a backfill takes over.
TITLE_MAX = 300


def recent_articles(resources: DataFrame, as_of: str, days: int) -> DataFrame:
    """``(resource_id, article_id, created)`` of articles in the window; pushed to the scan."""
    return within(resources.where((F.col("resource_type_definition_id") == ARTICLE) & F.col("external_id").isNotNull()), "created", as_of, days).select(F.col("id").alias("resource_id"), F.col("external_id").alias("article_id"), "created").distinct()


def latest_fingerprints(fingerprints: DataFrame, articles: DataFrame) -> DataFrame:
    """The latest fingerprint of each article, by time and then id; the window function gets only rows of wanted articles."""
    own = fingerprints.join(articles.select("article_id").distinct(), "article_id", "left_semi")
    return latest_row(own.select("article_id", "id", "last_enrich_utc", *FINGERPRINT), ["article_id"], "last_enrich_utc", "id").select("article_id", *FINGERPRINT)


def indicators(rows: DataFrame, articles: DataFrame, whole_rows: bool = True) -> DataFrame:
    """Status and message of both indicator kinds per article, in one aggregation over one join.

    ``whole_rows`` takes the last row as it is; otherwise each column's last value that isn't null.
    Ties in time are broken by status and message.
    """
    order = F.struct("created", "status", "message")
    own = rows.join(articles.select("resource_id", "article_id"), "resource_id")
    out = []
    for kind, name in ((DOCUMENT, "wd"), (RISK, "pm")):
        mine = F.col("indicator_definition_id") == kind
        for c in ("status", "message"):
            place = F.when(mine if whole_rows else mine & F.col(c).isNotNull(), order)
            out.append(F.max_by(c, place).alias(f"{name}_{c}"))
    return own.where(F.col("indicator_definition_id").isin(DOCUMENT, RISK)).groupBy("article_id").agg(*out)


def author_rank():
    """0 for submitting, 1 for corresponding, 2 for other authors."""
    role = F.lower(F.coalesce("role", F.lit("")))
    return F.when(role == "submitting author", 0).when(role == "corresponding author", 1).otherwise(2)


def primary_author(authors: DataFrame) -> DataFrame:
    """Per article the first value of each column that isn't null, by role and then by the columns themselves; values may come from different authors."""
    cols = ["first_name", "middle_name", "last_name", "email", "organisation", "ip_address"]
    order = [author_rank(), *(F.coalesce(c, F.lit("￿")) for c in cols)]
    return first_non_null(authors.where("article_id is not null"), ["article_id"], order, cols)


def author_ip(authors: DataFrame) -> DataFrame:
    """One address per article that isn't blank: of the first author by role."""
    own = authors.where(F.col("article_id").isNotNull() & (F.coalesce(F.trim("ip_address"), F.lit("")) != "")).select("article_id", author_rank().alias("r"), "ip_address")
    return own.groupBy("article_id").agg(F.min(F.struct("r", "ip_address")).alias("_m")).select("article_id", F.col("_m.ip_address").alias("author_ip"))


def latest_versions(versions: DataFrame) -> DataFrame:
    """The latest version of each resource, by version and then id: found on the keys alone, the text is joined to the winners. Rows without either id take no part."""
    keys = versions.where("resource_id is not null and id is not null").groupBy("resource_id").agg(F.max(F.struct(F.coalesce("version", F.lit(-1)).alias("version"), "id")).alias("_m")).select("resource_id", F.col("_m.id").alias("id"))
    return versions.join(keys, ["resource_id", "id"], "left_semi").select("resource_id", "id", "version", "resource_model").distinct()


def model_scalars(latest: DataFrame) -> DataFrame:
    """Stage, title, journal and section of each record; null where the text can't be read or has none.

    Scalars only: an object or array under a path gives null. The text is parsed once per row.
    """
    strip = lambda c: F.regexp_replace(c, r"^[\s\x{feff}]+|[\s\x{feff}]+$", "")
    first = F.try_parse_json(strip(F.col("resource_model")))
    root = F.coalesce(F.try_parse_json(strip(F.try_variant_get("_v", "$", "string"))), F.col("_v"))
    paths = {"stage_id": ("$.review.stage.id", "int"), "stage_name": ("$.review.stage.name", "string"), "title": ("$.submission.manuscriptDetails.title", "string"), "journal": ("$.submission.manuscriptDetails.journalName", "string"), "section": ("$.submission.manuscriptDetails.sectionName", "string")}
    rows = latest.select("resource_id", "id", first.alias("_v")).select("resource_id", "id", F.when(F.schema_of_variant("_v") == "STRING", root).otherwise(F.col("_v")).alias("_r"))
    return rows.select("resource_id", "id", *(F.try_variant_get("_r", p, t).alias(n) for n, (p, t) in paths.items()))


def author_pick(nodes: DataFrame, slots: int | None = None) -> DataFrame:
    """Name, e-mail and organisation of one author per record: submitting, then corresponding, then first, among those with a name or an e-mail.

    Read are the full name, the primary e-mail and the ``name`` of the first affiliation, as a scan of fixed paths reads
    them; no other member stands in for one that is missing. ``slots`` may bound the positions looked at; by default all are.
    """
    from ligature.functions.text import clean

    authors = nodes.where("node = 'author'").select("version_id", "author_pos", clean(F.col("full_name")).alias("name"), clean(F.col("primary_email")).alias("email"), "is_submitting", "is_corresponding").distinct()
    if slots is not None:
        authors = authors.where(F.col("author_pos") < slots)
    rank = F.when(F.col("is_submitting"), 0).when(F.col("is_corresponding"), 1).otherwise(2)
    picked = best_row(authors.where("name <> '' or email <> ''"), ["version_id"], [rank, F.col("author_pos"), F.col("name"), F.col("email")])
    orgs = nodes.where("node = 'affiliation' and affil_pos = 0").groupBy("version_id", "author_pos").agg(F.min("name").alias("org"))
    return picked.join(orgs, ["version_id", "author_pos"], "left").select("version_id", "author_pos", "name", "email", F.coalesce(clean(F.col("org")), F.lit("")).alias("org"))


def author_orgs(nodes: DataFrame) -> DataFrame:
    """``(version_id, author_pos, has_primary, primary_org, first_org)``: of the primary affiliation the organisation name before the name, of the first one the name before the organisation name; empty ones are null."""
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    own = nodes.where("node = 'primary' or (node = 'affiliation' and affil_pos = 0)").select("version_id", "author_pos", "node", F.when(F.col("node") == "primary", F.coalesce(full("organisation"), full("name"))).otherwise(F.coalesce(full("name"), full("organisation"))).alias("org"))
    return own.groupBy("version_id", "author_pos").agg(F.max(F.col("node") == "primary").alias("has_primary"), F.min(F.when(F.col("node") == "primary", F.col("org"))).alias("primary_org"), F.min(F.when(F.col("node") != "primary", F.col("org"))).alias("first_org"))


def named_authors(nodes: DataFrame) -> DataFrame:
    """``(version_id, author_pos, name, email, is_submitting)`` of every author; name and e-mail are null where there is none."""
    from ligature.functions.text import display_name

    name = display_name(F.col("first_name"), F.col("middle_name"), F.col("last_name"), F.col("full_name"))
    email = F.coalesce(F.nullif("primary_email", F.lit("")), F.nullif("email", F.lit("")))
    return nodes.where("node = 'author'").select("version_id", "author_pos", F.nullif(name, F.lit("")).alias("name"), email.alias("email"), F.coalesce("is_submitting", F.lit(False)).alias("is_submitting")).distinct()


def submitting_author(nodes: DataFrame) -> DataFrame:
    """``(version_id, name, email, affiliation)`` of the submitting, else the first author of each record: of the primary affiliation if it is an object, else of the first one."""
    one = best_row(named_authors(nodes), ["version_id"], [F.when(F.col("is_submitting"), 0).otherwise(1), F.col("author_pos"), F.col("name"), F.col("email")])
    org = F.when(F.col("has_primary"), F.col("primary_org")).otherwise(F.col("first_org"))
    return one.join(author_orgs(nodes), ["version_id", "author_pos"], "left").select("version_id", "name", "email", org.alias("affiliation"))


def all_authors(nodes: DataFrame) -> DataFrame:
    """``(version_id, author_pos, name, email, role, org)`` of every author; the first affiliation stands in where the primary one gives no organisation; nothing is the empty string."""
    from ligature.functions.text import strip

    role = F.when(F.col("is_submitting"), "Submitting author").otherwise("Author")
    org = F.coalesce(F.nullif(strip(F.col("primary_org")), F.lit("")), strip(F.col("first_org")), F.lit(""))
    return named_authors(nodes).join(author_orgs(nodes), ["version_id", "author_pos"], "left").select("version_id", "author_pos", F.coalesce("name", F.lit("")).alias("name"), F.coalesce(strip(F.col("email")), F.lit("")).alias("email"), role.alias("role"), org.alias("org"))


def assemble(resources: DataFrame, fingerprints: DataFrame, indicator_rows: DataFrame, authors: DataFrame, context: DataFrame, as_of: str, days: int) -> DataFrame:
    """The article table of a window from its parts, each joined once on article_id. Addresses are joined to the articles directly."""
    articles = recent_articles(resources, as_of, days)
    parts = [latest_fingerprints(fingerprints, articles), indicators(indicator_rows, articles), author_ip(authors), context]
    out = articles.select("article_id", "created")
    for p in parts:
        out = out.join(p, "article_id", "left")
    return out

