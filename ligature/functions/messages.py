"""Facts in indicator messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ligature.functions.text import clean, strip

# Status codes of the document check.
STATUS = {1: "green", 2: "yellow", 3: "red", 4: "n/a", 7: "gold", 9: "unchecked"}
# What the messages of the checks say, in one place.
RISK_SCORE = r"(?i)risk:\s*([\d.]+)\s*%"
RISK_BAND = r"(?i)(low|medium|high)\s+risk"
LIST_ITEM = r"(?is){label}:\s*(.*?)\s*</li>"
NO_MATCH, MATCH = "does not match", "matches the author"
# Codes of the exported enumerations.
BAND_CODE = {"": 0, "low": 1, "medium": 2, "high": 3}
STATUS_CODE = {"": 0, "green": 1, "yellow": 2, "red": 3, "gold": 4, "n/a": 5, "unchecked": 6}
PATTERN_CODE = {"": 0, "all-digits": 1, "name.surname": 2, "all-alpha": 3, "alpha+digits": 4, "other": 5}


def code_of(name: Column, codes: dict[str, int]) -> Column:
    """Code of an enumeration's name; 0 for null and unknown ones."""
    table = F.create_map(*(x for k, v in codes.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(table[name], F.lit(0))


def name_at(code: Column, codes: dict[str, int]) -> Column:
    """The name at a position of an enumeration's pool; empty out of range or for null."""
    pool = F.array(*(F.lit(k) for k, _ in sorted(codes.items(), key=lambda x: x[1])))
    return F.coalesce(F.get(pool, code), F.lit(""))


def tri_state(flag: Column) -> Column:
    """1 for true, 0 for false, -1 for null."""
    return F.coalesce(flag.cast("int"), F.lit(-1))


def risk_score(message: Column) -> Column:
    """The percentage after ``risk:``, or null."""
    return F.nullif(F.regexp_extract(message, RISK_SCORE, 1), F.lit("")).try_cast("double")


def risk_band(message: Column) -> Column:
    """low, medium or high before ``risk``, or empty."""
    return F.coalesce(F.lower(F.regexp_extract(message, RISK_BAND, 1)), F.lit(""))


def raw_field(message: Column, label: str) -> Column:
    """The value of one list item, stripped, or empty."""
    return strip(F.regexp_extract(message, LIST_ITEM.format(label=label), 1))


def document_field(message: Column, label: str) -> Column:
    """The cleaned value of one list item, or empty."""
    return clean(raw_field(message, label))


def document_match(message: Column) -> Column:
    """False for ``does not match``, true for ``matches the author``, else null."""
    text = F.lower(message)
    return F.when(F.contains(text, F.lit(NO_MATCH)), False).when(F.contains(text, F.lit(MATCH)), True)


def status_name(code: Column) -> Column:
    """Name of a status code, or empty."""
    table = F.create_map(*(x for k, v in STATUS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(table[code.cast("int")], F.lit(""))
