"""Upload planning: F8 candidates, X11 file types, X12 keys, K5 template rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import basename, file_type, upload_key, upload_uri
from ..sinks.tables import submission_rows
from .filters import upload_candidates


def upload_plan(inventory: DataFrame, bucket: str, prefix: str | None, path: str = "path") -> DataFrame:
    """Accepted files with their object key, uri and submission file type."""
    c = upload_candidates(inventory).where(F.col("accepted"))
    name = basename(F.col(path))
    p = F.lit(prefix) if prefix is not None else F.lit(None).cast("string")
    return c.select(path, name.alias("filename"), file_type(name).alias("filetype"),
                    upload_key(p, name).alias("key"), upload_uri(F.lit(bucket), p, name).alias("uri"))


def submission_template(inventory: DataFrame, bucket: str, prefix: str | None, path: str = "path") -> DataFrame:
    """K5 rows for the accepted files."""
    return submission_rows(upload_candidates(inventory).where(F.col("accepted")), bucket, prefix, path)
