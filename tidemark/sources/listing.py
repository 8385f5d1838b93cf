"""Object listings (S3 inventory tables): S3 clean-up and S4 single lookup.

A listing is any DataFrame with ``bucket``, ``key``, ``size`` and ``etag``
(an S3 Inventory report in Parquet/CSV, or a landed listing).  Filters on
``bucket``/``key`` prefixes reach the Parquet scan as pushed predicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import etag_md5, fail_if, relative_key, wildcard_keep


def read_listing(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read an inventory listing; only the four listing columns are selected so
    the scan prunes everything else."""
    df = spark.read.format(fmt).load(path)
    return df.select("bucket", "key", F.col("size").cast("long").alias("size"), "etag")


def _error_policy(df: DataFrame, bad, message, on_error: str) -> DataFrame:
    if on_error == "fail":
        return fail_if(df, bad, message)
    if on_error == "quarantine":
        return df.withColumn("reason", F.when(bad, message))
    raise ValueError("on_error must be 'fail' or 'quarantine'")


def clean_listing(listing: DataFrame, prefix: str = "", exclude: str | None = None,
                  include: str | None = None, on_error: str = "fail") -> DataFrame:
    """S3: listing clean-up in the archive tool's order.

    Rows without a key or a size are skipped; directory markers (key ends with
    ``/`` and size 0) are skipped; the key relative to ``prefix`` passes the
    wildcard filter (F6); a negative size is then an error (``fail`` raises,
    ``quarantine`` keeps the row with a ``reason``).  Adds ``rel_key`` and the
    md5 taken from the ETag.
    """
    k, s = F.col("key"), F.col("size")
    df = listing.where(k.isNotNull() & s.isNotNull() & ~(k.endswith("/") & (s == 0)))
    if prefix:
        df = df.where(k.startswith(prefix))  # pushed to the scan as StringStartsWith
    df = df.withColumn("rel_key", relative_key("key", F.lit(prefix)))
    if exclude is not None or include is not None:
        df = df.where(wildcard_keep("rel_key", exclude, include))
    df = df.withColumn("md5", etag_md5("etag"))
    msg = F.concat(F.lit("S3 object has an invalid size: s3://"), F.col("bucket"), F.lit("/"), k)
    return _error_policy(df, s < 0, msg, on_error)


def lookup_object(listing: DataFrame, bucket: str, key: str, on_error: str = "fail") -> DataFrame:
    """The single object of a ``file`` catalogue entry.

    The key must be non-empty and must not end with ``/`` (checked on the
    driver); the lookup is an equality filter pushed to the scan; a missing
    size is an error.
    """
    if not key or key.endswith("/"):
        raise ValueError(f"file entries need an object key, got s3://{bucket}/{key}")
    df = listing.where((F.col("bucket") == bucket) & (F.col("key") == key))
    df = df.withColumn("md5", etag_md5("etag"))
    msg = F.lit(f"S3 object has no size: s3://{bucket}/{key}")
    return _error_policy(df, F.col("size").isNull(), msg, on_error)


def lookup_objects(listing: DataFrame, requests: DataFrame) -> DataFrame:
    """S4 for many requests at once: semi-join of the listing on (bucket, key)
    with per-request status (``found``, ``no size``, ``missing``, ``bad key``)."""
    bad_key = (F.col("key") == "") | F.col("key").endswith("/")
    # a listing taken twice has an object twice: one row each, the one with a size first
    found = (listing.join(requests.select("bucket", "key").distinct(), ["bucket", "key"], "left_semi")
             .groupBy("bucket", "key").agg(F.max(F.struct("size", etag_md5("etag").alias("md5"))).alias("_o"))
             .select("bucket", "key", "_o.size", "_o.md5", F.lit(True).alias("_hit")))
    j = requests.join(found, ["bucket", "key"], "left")
    status = (F.when(bad_key, F.lit("bad key"))
              .when(F.col("_hit").isNull(), F.lit("missing"))
              .when(F.col("size").isNull(), F.lit("no size"))
              .otherwise(F.lit("found")))
    return j.withColumn("status", status).drop("_hit")
