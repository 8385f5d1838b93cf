"""Transfer events as a tagged JSON union, one object per line.

``{"type": "Progress", "data": {...}}``: the tag names a variant, the variant has
its own fields.  One stream (or batch) of lines is dispatched by tag into one typed
struct column per variant; unknown tags and lines that do not fit their variant stay
in the same frame with a reason, so nothing is lost between the two.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The variants of the event unions and their fields; ``?`` marks optional ones.
_FILES = "files array<struct<run_id string, file1 string, size1 bigint, file2 string, size2 bigint>>"
DOWNLOAD_EVENTS = {
    "Log": "level string, message string",
    "Progress": "run_id string, percent double, status string, speed_mbps double",
    "Started": "total bigint",
    "Completed": "",
    "Error": "message string",
    "DryRun": _FILES,
    "Metadata": "records array<map<string,string>>",
}
UPLOAD_EVENTS = {
    "Log": "level string, message string",
    "Progress": "filename string, percent double, status string",
    "Started": "total bigint",
    "Completed": "",
    "Error": "message string",
    "DryRun": "files array<string>",
}
_BAD = "_bad"


def column_of(tag: str) -> str:
    """Column name of a variant: ``DryRun`` -> ``dry_run``."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", tag).lower()


def parse_tagged(lines: DataFrame, variants: Mapping[str, str] = DOWNLOAD_EVENTS, value: str = "value") -> DataFrame:
    """Adds ``tag``, one struct column per variant with fields (null for other tags)
    and ``reason`` to rows with a JSON line in ``value``.

    ``reason`` is null for a good row, else ``bad json`` (no object with a text ``type``),
    ``unknown type`` or ``bad data`` (a field missing, null or of another kind).  Fields
    that the variant does not name are ignored, blank lines are bad json."""
    outer = F.from_json(F.col(value), f"type string, data string, {_BAD} string", {"columnNameOfCorruptRecord": _BAD})
    out = lines.withColumn("_o", outer).withColumn("tag", F.when(F.col(f"_o.{_BAD}").isNull(), F.col("_o.type")))
    bad = F.lit(False)
    for tag, fields in variants.items():
        if not fields:
            continue
        names = T._parse_datatype_string(fields).fieldNames()
        data = F.from_json(F.col("_o.data"), f"{fields}, {_BAD} string", {"columnNameOfCorruptRecord": _BAD})
        out = out.withColumn(f"_d_{tag}", F.when(F.col("tag") == tag, data))
        whole = F.col(f"_d_{tag}.{_BAD}").isNull()
        for n in names:
            whole = whole & F.col(f"_d_{tag}.{n}").isNotNull()
        bad = bad | ((F.col("tag") == tag) & ~F.coalesce(whole, F.lit(False)))
        out = out.withColumn(f"_ok_{tag}", F.when((F.col("tag") == tag) & whole, F.struct(*[F.col(f"_d_{tag}.{n}").alias(n) for n in names])))
    reason = (F.when(F.col("tag").isNull(), F.lit("bad json")).when(~F.col("tag").isin(*variants), F.lit("unknown type"))
              .when(bad, F.lit("bad data")))
    typed = [F.col(f"_ok_{tag}").alias(column_of(tag)) for tag, fields in variants.items() if fields]
    return out.select(*[F.col(c) for c in lines.columns], "tag", *typed, reason.alias("reason"))


def variant(events: DataFrame, tag: str) -> DataFrame:
    """The good rows of one variant, its fields as columns."""
    rows = events.where((F.col("tag") == tag) & F.col("reason").isNull())
    return rows.select(f"{column_of(tag)}.*") if column_of(tag) in events.columns else rows.select("tag")


def rejects(events: DataFrame, value: str = "value") -> DataFrame:
    """(line, reason) of the rows that fit no variant."""
    return events.where("reason is not null").select(F.col(value).alias("line"), "reason")


def read_tagged(spark: SparkSession, path: str, variants: Mapping[str, str] = DOWNLOAD_EVENTS, stream: bool = True,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """S12 source: landed JSON lines as a stream (or batch) of tagged events."""
    r = spark.readStream if stream else spark.read
    if stream and max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_tagged(r.text(path), variants)
