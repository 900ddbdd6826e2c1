"""Blank rule and normalisation as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as blank after trimming spaces and tabs and lower-casing.
BLANKS = ("", "na", "n/a", "none", "nan", "null", "unknown", "-")


def trimmed(col: Column) -> Column:
    """Without leading and trailing spaces and tabs; null stays null."""
    return F.trim(col.cast("string"), F.lit(" \t"))


def normal(col: Column) -> Column:
    """Trimmed lower-case value, or null where it is blank."""
    value = F.lower(trimmed(col))
    return F.when(value.isin(*BLANKS), None).otherwise(value)


def is_blank(col: Column) -> Column:
    """True for null and for the blank spellings, never null."""
    return normal(col).isNull()

#: White space as Python's ``str.strip`` sees it.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.trim(col.cast("string"), F.lit(SPACE))


def unblank(stripped: Column) -> Column:
    """A stripped value, or the empty string for null and the blank spellings."""
    return F.when(stripped.isNull() | F.lower(stripped).isin(*BLANKS), "").otherwise(stripped)


def clean(col: Column) -> Column:
    """Stripped value, or the empty string for null and the blank spellings."""
    return unblank(strip(col))


def local_part(email: Column) -> Column:
    """What stands before the first ``@``; empty without one."""
    return F.when(F.coalesce(F.contains(email, F.lit("@")), F.lit(False)), F.substring_index(email, "@", 1)).otherwise("")


def email_pattern(email: Column) -> Column:
    """Shape of the local part: all-digits, name.surname, all-alpha, alpha+digits, other, or empty."""
    local = F.lower(local_part(email))
    return (
        F.when(local == "", "")
        .when(local.rlike(r"^(?U)\d+$"), "all-digits")
        .when(local.rlike(r"^[a-z]+\.[a-z]+$"), "name.surname")
        .when(local.rlike(r"^[a-z]+$"), "all-alpha")
        .when(local.rlike(r"[a-z]") & local.rlike(r"(?U)\d"), "alpha+digits")
        .otherwise("other")
    )


def has_letters(email: Column) -> Column:
    """Whether the local part holds a letter a to z."""
    return local_part(email).rlike("[a-zA-Z]")


def digits_only(email: Column) -> Column:
    """Whether the local part is digits and nothing else."""
    return local_part(email).rlike(r"^(?U)\d+$")


def letters_and_digits(col: Column) -> Column:
    """Lower case without anything but a-z and 0-9; empty for null."""
    return F.coalesce(F.regexp_replace(F.lower(col), "[^a-z0-9]+", ""), F.lit(""))


def display_name(first: Column, middle: Column, last: Column, full: Column | None = None) -> Column:
    """The full name if there is one, else the parts that aren't empty, joined by spaces."""
    joined = strip(F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (first, middle, last))))
    return joined if full is None else F.when(F.coalesce(full, F.lit("")) != "", strip(full)).otherwise(joined)


def full_name(*parts: Column) -> Column:
    """The parts with single spaces between, or null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts)), " +", " ")), F.lit(""))
