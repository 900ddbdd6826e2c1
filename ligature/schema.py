"""The fixed article schema and conforming to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The article table, 34 columns in a fixed order.
ARTICLES = T.StructType(
    [
        T.StructField("article_id", T.LongType()),
        T.StructField("created", T.TimestampNTZType()),
        T.StructField("ip_hash", T.StringType()),
        T.StructField("asn_hash", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("canvas_hash", T.StringType()),
        T.StructField("webgl_hash", T.StringType()),
        T.StructField("hw_id_hash", T.StringType()),
        T.StructField("ua_family_hash", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("screen_width", T.IntegerType()),
        T.StructField("screen_height", T.IntegerType()),
        T.StructField("device_pixel_ratio", T.DoubleType()),
        T.StructField("languages", T.StringType()),
        T.StructField("timezone", T.StringType()),
        T.StructField("ua_family", T.StringType()),
        T.StructField("wd_status", T.IntegerType()),
        T.StructField("wd_message", T.StringType()),
        T.StructField("pm_status", T.IntegerType()),
        T.StructField("pm_message", T.StringType()),
        T.StructField("author_name", T.StringType()),
        T.StructField("author_email", T.StringType()),
        T.StructField("author_org", T.StringType()),
        T.StructField("author_ip", T.StringType()),
        T.StructField("article_title", T.StringType()),
        T.StructField("stage_id", T.IntegerType()),
        T.StructField("stage_name", T.StringType()),
        T.StructField("rejection_reason", T.StringType()),
        T.StructField("rejection_code", T.StringType()),
        T.StructField("journal", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("article_type", T.StringType()),
        T.StructField("editors", T.StringType()),
        T.StructField("reviewers", T.StringType()),
    ]
)
FINGERPRINT = tuple(ARTICLES.names[2:16])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the schema's columns, in order: missing ones null, extra ones dropped, others cast (null where they can't be)."""
    have = set(df.columns)
    return df.select(*((F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))
