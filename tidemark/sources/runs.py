"""Run reports: S1 TSV scan, S2 accession reports, U1 union.

Reports are read by header name (never by position), every field as text.
Lines starting with ``#`` (the optional project-accession line) are skipped,
unknown columns are ignored and absent ones become null; the four columns the
archive tool defaults to ``''`` get that default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import normalize_report, union_reports
from ..schemas import RUN_REPORT_COLUMNS, RUN_REPORT_DEFAULT_EMPTY
from .rejects import reject_rows
from .reports import read_tsv_by_header


def _tsv(spark: SparkSession, path: str, recursive: bool = False, multiline: bool = False):
    r = (spark.read.option("sep", "\t").option("header", True).option("comment", "#")
         .option("quote", '"').option("escape", '"').option("inferSchema", False)
         .option("mode", "FAILFAST").option("multiLine", multiline))
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.csv(path)


def read_run_report(spark: SparkSession, path: str, recursive: bool = False, mode: str = "fail") -> DataFrame:
    """One or more run-report TSV files -> the 49 report columns.

    Every file is mapped by its own header (Spark's CSV reader would map the
    later files of a directory by position), ``#`` lines are skipped, fields
    may be quoted (tabs, newlines and doubled quotes inside quotes).  A file is
    read by many tasks.  Bad records fail the job; ``mode='quarantine'`` leaves
    them out here, and :func:`report_rejects` returns them."""
    parsed = read_tsv_by_header(spark, path, recursive=recursive, mode=mode, columns=RUN_REPORT_COLUMNS)
    return _report_columns(parsed if mode == "fail" else parsed.where("error is null"))


def report_rejects(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """The records that ``read_run_report(mode='quarantine')`` leaves out: (source, line_no, line, reason)."""
    bad = read_tsv_by_header(spark, path, recursive=recursive, mode="quarantine").where("error is not null")
    return reject_rows(bad, F.col("error"), F.col("file"), F.col("line"), F.col("line_no"))


def read_run_report_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """S1 through Spark's CSV reader -- for a set of files that share one
    header.  ``multiline=True`` also accepts newlines inside quoted fields
    (each file is then read by one task, as such files cannot be split)."""
    return normalize_report(_tsv(spark, path, multiline=multiline))


def _report_columns(parsed: DataFrame, extra: dict | None = None) -> DataFrame:
    cols = []
    for c in RUN_REPORT_COLUMNS:
        v = F.col("row").getItem(c)
        cols.append((F.coalesce(v, F.lit("")) if c in RUN_REPORT_DEFAULT_EMPTY else v).alias(c))
    cols += [v.alias(k) for k, v in (extra or {}).items()]
    return parsed.select(*cols)


def read_accession_reports(spark: SparkSession, root: str, pattern: str = r"([^/]+)_metadata/[^/]*$", mode: str = "fail") -> DataFrame:
    """A landing directory with one report per accession; the accession
    is taken from the path (``<acc>_metadata/...`` by default).  Reports may
    carry different column sets; each row is mapped by its own file's header.
    """
    acc = F.nullif(F.regexp_extract(F.col("file"), pattern, 1), F.lit(""))
    parsed = read_tsv_by_header(spark, root, recursive=True, mode=mode, columns=RUN_REPORT_COLUMNS, of_file={"accession": acc})
    parsed = parsed if mode == "fail" else parsed.where("error is null")
    return _report_columns(parsed, {"accession": F.col("accession")})


def union_run_reports(*dfs: DataFrame) -> DataFrame:
    """Reports from several sources concatenated by column name; an
    ``accession`` column is kept (null for sources without one)."""
    out = []
    for d in dfs:
        acc = F.col("accession") if "accession" in d.columns else F.lit(None).cast("string")
        out.append(normalize_report(d, extra={"accession": acc}))
    return union_reports(*out)
