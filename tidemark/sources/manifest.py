"""Checksum manifests (S5) and directory inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import fail_if, trim_ws
from ..operators.filters import is_md5_log
from .rejects import reject_rows
from .text import read_numbered_lines


def parse_manifest_lines(lines: DataFrame, value: str = "value", line_no: str = "line_no",
                         file: str = "file", mode: str = "quarantine", keep: str | None = None) -> DataFrame:
    """md5sum-style lines -> (file, line_no, md5, filename[, error]).

    The line is trimmed; empty lines and ``#`` comments are skipped; it is split
    once on two spaces; the md5 is lower-cased and must be 32 hex digits.
    ``mode='fail'`` raises on the first bad line seen (with its 1-based line
    number); ``quarantine`` keeps bad lines with an ``error`` text.
    """
    t = trim_ws(value)
    kept = lines.withColumn("_t", t).where((F.col("_t") != "") & ~F.col("_t").startswith("#"))
    pos = F.instr(F.col("_t"), "  ")
    md5 = F.lower(F.when(pos > 0, F.substring_index(F.col("_t"), "  ", 1)))
    name = F.when(pos > 0, F.expr("substring(_t, instr(_t, '  ') + 2)"))
    error = (F.when(pos == 0, F.format_string("Invalid line %d in %s: expected '<md5>  <filename>'",
                                                 F.col(line_no), F.col(file)))
             .when(~md5.rlike("^[0-9a-f]{32}$"),
                   F.format_string("Invalid MD5 on line %d in %s: %s", F.col(line_no), F.col(file), md5)))
    out = kept.select(F.col(file).alias("file"), F.col(line_no).alias("line_no"), md5.alias("md5"),
                      name.alias("filename"), error.alias("error"), *([F.col(keep)] if keep else []))
    if mode == "fail":
        return fail_if(out, F.col("error").isNotNull(), F.col("error")).drop("error")
    if mode != "quarantine":
        raise ValueError("mode must be 'fail' or 'quarantine'")
    return out.withColumn("md5", F.when(F.col("error").isNull(), F.col("md5"))) \
        .withColumn("filename", F.when(F.col("error").isNull(), F.col("filename")))


def manifest_rejects(lines: DataFrame, value: str = "value", line_no: str = "line_no", file: str = "file") -> DataFrame:
    """The bad lines as (source, line_no, line, reason); the line is trimmed."""
    bad = parse_manifest_lines(lines.withColumn("_line", trim_ws(value)), value, line_no, file, keep="_line")
    return reject_rows(bad, F.col("error"), F.col("file"), F.col("_line"), F.col("line_no"))


def read_manifest(spark: SparkSession, path: str, mode: str = "fail") -> DataFrame:
    """S5 source: read manifest files with line numbers and parse them."""
    return parse_manifest_lines(read_numbered_lines(spark, path), mode=mode)


def hidden_component(rel_path: Column) -> Column:
    """True when any path component starts with ``.``."""
    return rel_path.rlike(r"(^|/)\.")


def filter_inventory(files: DataFrame, root: str, path: str = "path",
                     log_prefix: str | None = None) -> DataFrame:
    """S6 rules on a listing table: keep files under ``root`` whose relative
    path has no hidden component (name starting with ``.``) and which are not
    the tool's own logs.  Adds ``rel_path``."""
    r = root.rstrip("/") + "/"
    p = F.col(path)
    rel = F.expr(f"substring({path}, {len(r) + 1})")
    name = F.substring_index(p, "/", -1)
    log = is_md5_log(name) if log_prefix is None else is_md5_log(name, log_prefix)
    return (files.where(p.startswith(r)).withColumn("rel_path", rel)
            .where(~hidden_component(F.col("rel_path")) & ~log))


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """S6 source: recursive listing of a directory tree as (path, length,
    modification_time); file content is never read (the projection prunes
    the ``content`` column of the binary-file source).

    Note: Spark's file index also skips names starting with ``_``; use a
    listing table with :func:`filter_inventory` when such files matter.
    """
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
          .select(F.regexp_replace(F.col("path"), "^file:/*", "/").alias("path"), "length",
                  F.col("modificationTime").alias("modification_time")))
    import re
    return filter_inventory(df, re.sub(r"^file:/*", "/", root)).drop("rel_path")
