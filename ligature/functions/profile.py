"""Key and digest of a device profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ligature.functions.text import strip

#: Fields that a complete profile has.
REQUIRED = ("canvas_hash", "webgl_hash", "hw_id_hash", "ua_family_hash", "platform", "screen_width", "screen_height", "device_pixel_ratio")


def ratio_text(col: Column) -> Column:
    """A number with six significant digits, as short as possible (like the ``%g`` of C); text stays as it is, null is empty."""
    value = col.cast("string").try_cast("double")
    number = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", value), r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.when(F.isnan(value), "").when(value.isNotNull(), number).otherwise(F.coalesce(strip(col), F.lit("")))


def screen_text(col: Column) -> Column:
    """A whole number as text (cut towards zero), other text as it is, null empty."""
    return F.coalesce(col.cast("string").try_cast("double").cast("bigint").cast("string"), strip(col), F.lit(""))


def profile_key(c: dict[str, Column] | None = None) -> Column:
    """Seven parts joined by ``|``; the screen only if both sides are known. All blank gives the empty string."""
    get = (lambda n: c[n]) if c else F.col
    width, height = screen_text(get("screen_width")), screen_text(get("screen_height"))
    screen = F.when((width != "") & (height != ""), F.concat(width, F.lit("x"), height)).otherwise("")
    parts = [F.coalesce(strip(get(n)), F.lit("")) for n in REQUIRED[:5]]
    key = F.concat_ws("|", *parts, screen, ratio_text(get("device_pixel_ratio")))
    return F.when(key.rlike(r"^\|*$"), "").otherwise(key)


def profile_errors() -> Column:
    """Names of the required fields that are blank."""
    return F.array_compact(F.array(*(F.when(F.coalesce(strip(F.col(n)), F.lit("")) == "", F.lit(n)) for n in REQUIRED)))


def profile_id(strict: bool = False) -> Column:
    """SHA-256 of the key; without any component the device id as it is; strict: null unless complete."""
    key = profile_key()
    digest = F.sha2(key, 256)
    if strict:
        return F.when(F.size(profile_errors()) == 0, digest)
    return F.when(key == "", F.coalesce(strip(F.col("device_id")), F.lit(""))).otherwise(digest)


def token_of_key(key: str, device_id: str) -> Column:
    """The device token from a column that already holds the key."""
    own = F.coalesce(strip(F.col(device_id)), F.lit(""))
    return F.when(F.col(key) != "", F.substring(F.sha2(key, 256), 1, 16)).when(own.rlike("^[a-f0-9]{64}$"), F.substring(own, 1, 16)).otherwise("")


def device_token(strict: bool = False) -> Column:
    """First 16 digits of a full digest, else empty."""
    value = F.coalesce(profile_id(strict), F.lit(""))
    return F.when(value.rlike("^[a-f0-9]{64}$"), F.substring(value, 1, 16)).otherwise("")
