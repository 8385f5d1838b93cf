"""Row filters and predicates.

Patterns given by the user are checked on the driver before any job starts;
the predicates themselves are Catalyst expressions with literal patterns, so
each pattern is compiled once per task by codegen.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import _c, canonical_path, is_paired
from ..functions.patterns import InvalidPattern, PatternError, UnsupportedPattern, has_references, translate  # noqa: F401
from ..schemas import DEFAULT_MANIFEST_NAME, MD5_LOG_PREFIX, MD5_LOG_SUFFIX

def java_regex(pattern: str, dialect: str = "tool", ignore_case: bool = False) -> str:
    """The Java pattern that matches what ``pattern`` does in its dialect, checked on
    the driver by the JVM's own compiler (which will run it)."""
    java = translate(pattern, dialect, ignore_case)
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(java)
        except (Py4JJavaError, IllegalArgumentException) as e:
            raise UnsupportedPattern(f"unsupported pattern {pattern!r}: {str(e).splitlines()[0]}") from None
    return java


def _any_match(col: Column, patterns: Sequence[str]) -> Column:
    """True when any of these Java patterns is found in ``col``.  They are folded into
    one alternation, so each row runs one regex however long the list is."""
    patterns = list(patterns)
    if not patterns:
        return F.lit(False)
    if len(patterns) == 1 or any(has_references(p) for p in patterns):  # references count groups of their own pattern
        return reduce(Column.__or__, [col.rlike(p) for p in patterns])
    return col.rlike("|".join(f"(?:{p})" for p in patterns))


def regex_keep(sample_title="sample_title", run_accession="run_accession",
               include_sample: Iterable[str] = (), include_run: Iterable[str] = (),
               exclude_sample: Iterable[str] = (), exclude_run: Iterable[str] = (),
               case_insensitive: bool = False, dialect: str = "tool") -> Column:
    """F1 predicate: non-empty include lists must match; any exclude match drops.

    Unanchored, case-sensitive by default; a null title counts as ``''``.
    """
    inc_s, inc_r, exc_s, exc_r = [[java_regex(p, dialect, case_insensitive) for p in group]
                                  for group in (include_sample, include_run, exclude_sample, exclude_run)]
    s = F.coalesce(_c(sample_title), F.lit(""))
    r = F.coalesce(_c(run_accession), F.lit(""))
    keep = F.lit(True)
    if inc_s:
        keep = keep & _any_match(s, inc_s)
    if inc_r:
        keep = keep & _any_match(r, inc_r)
    if exc_s:
        keep = keep & ~_any_match(s, exc_s)
    if exc_r:
        keep = keep & ~_any_match(r, exc_r)
    return keep


def regex_filter(df: DataFrame, include_sample=(), include_run=(), exclude_sample=(),
                 exclude_run=()) -> DataFrame:
    """filter a run report with include/exclude regex lists."""
    return df.where(regex_keep("sample_title", "run_accession", include_sample, include_run,
                               exclude_sample, exclude_run))


def filter_counts(df: DataFrame, predicate: Column) -> DataFrame:
    """one row (kept, dropped) in a single aggregate pass."""
    p = F.coalesce(predicate, F.lit(False))
    return df.agg(F.count_if(p).alias("kept"), F.count_if(~p).alias("dropped"))


def split_spec(text: str | None) -> list[str]:
    """Split a preview spec on commas and newlines, trim, drop blanks."""
    if not text:
        return []
    return [t.strip() for t in re.split(r"[,\n]", text) if t.strip()]


def preview_keep(filter_sample: str = "", filter_run: str = "", exclude_sample: str = "",
                 exclude_run: str = "") -> Column:
    """the interactive preview filter -- case-insensitive; an invalid pattern
    anywhere keeps every row.  A valid one that Java cannot express is an error."""
    specs = [split_spec(t) for t in (filter_sample, filter_run, exclude_sample, exclude_run)]
    try:
        for group in specs:
            for p in group:
                java_regex(p, "preview", True)
    except InvalidPattern:
        return F.lit(True)
    return regex_keep("sample_title", "run_accession", *specs, case_insensitive=True, dialect="preview")


def selected_counts(df: DataFrame, predicate: Column) -> DataFrame:
    """A12: "N of M" -- selected and total row counts in one pass."""
    p = F.coalesce(predicate, F.lit(False))
    return df.agg(F.count_if(p).alias("selected"), F.count(F.lit(1)).alias("total"))


def paired_only(df: DataFrame, urls: str = "fastq_ftp") -> DataFrame:
    """keep runs with two or more urls."""
    return df.where(is_paired(urls))


def is_md5_log(name, prefix: str = MD5_LOG_PREFIX) -> Column:
    """the checksum tool's own log files (``<prefix>*.log``)."""
    n = F.substring_index(_c(name), "/", -1)  # an entry may lie in a subfolder
    return n.startswith(prefix) & n.endswith(MD5_LOG_SUFFIX)


def drop_artifacts(df: DataFrame, name: str = "filename", prefix: str = MD5_LOG_PREFIX,
                   manifest_name: str | None = DEFAULT_MANIFEST_NAME,
                   path: str | None = None, manifest_path: str | None = None) -> DataFrame:
    """remove the tool's own logs and the manifest itself.

    With ``path``/``manifest_path`` the manifest is matched on its full path
    (``.`` and ``..`` components folded), otherwise on its file name.
    """
    cond = ~is_md5_log(name, prefix)
    if path and manifest_path:
        cond = cond & (canonical_path(path) != canonical_path(F.lit(manifest_path)))
    elif manifest_name:
        cond = cond & (F.col(name) != F.lit(manifest_name))
    return df.where(cond)


def upload_candidates(inventory: DataFrame, length: str = "length",
                      is_dir: str | None = None) -> DataFrame:
    """F8: every inventory row with ``accepted`` and a ``reason`` when rejected
    (directories and empty files are skipped with a warning by the tool)."""
    l = F.col(length)
    reason = F.when(l.isNull(), F.lit("missing"))
    if is_dir:
        reason = reason.when(F.col(is_dir), F.lit("directory"))
    reason = reason.when(l <= 0, F.lit("empty"))
    return inventory.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def log_level(df: DataFrame, level: str = "all", col: str = "level") -> DataFrame:
    """equality filter on the level; ``all`` passes everything."""
    if level == "all":
        return df
    return df.where(F.lower(F.col(col)) == F.lit(level.lower()))


def lint_catalog(catalog: DataFrame) -> DataFrame:
    """configuration checks as row checks -> ``issues`` array per entry."""
    url = F.col("s3_url")
    key = F.regexp_extract(F.trim(url), r"^s3://[^/]*/(.*)$", 1)
    checks = [
        F.when(~F.trim(url).startswith("s3://"), F.lit("s3_url must start with s3://")),
        F.when((F.col("database_type") == "file") & ((key == "") | key.endswith("/")),
               F.lit("file entry needs an object key that does not end with /")),
        F.when(F.col("validate.enabled") & (F.coalesce(F.col("validate.tool"), F.lit("")) != "blastdbcmd"),
               F.lit("validate.tool must be blastdbcmd")),
        F.when(~F.col("database_type").isin("file", "folder"),
               F.lit("type must be file or folder")),
    ]
    return catalog.withColumn("issues", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def region_warning(region) -> Column:
    """F10 (upload): buckets outside us-east-1 get a warning text."""
    r = _c(region)
    return F.when(r != "us-east-1", F.concat(F.lit("bucket region is "), r, F.lit(", not us-east-1")))
