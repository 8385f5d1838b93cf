"""Run-report processing: X3 process_runs, A13 capacity_plan, A15 study_rollup,
U1 union_reports.  All are narrow projections or partial-aggregating group-bys:
no shuffle except the final group-by, which combines map-side first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import basename, downloadable, is_paired, packed_list, size_list
from ..schemas import FASTQ_EXPANSION, RUN_REPORT_COLUMNS, RUN_REPORT_DEFAULT_EMPTY
from .filters import regex_keep


def process_runs(df: DataFrame, pe_only: bool = False, filters: dict | None = None,
                 aligned_sizes: bool = False) -> DataFrame:
    """One row per downloadable run with mate-1 / mate-2 columns.

    * urls and md5s are ``;``-packed, blanks dropped; sizes keep valid u64 only
      (positions shift when one is bad unless ``aligned_sizes``);
    * a run needs >= 1 url and >= 1 md5 (F4); ``pe_only`` needs >= 2 urls (F5);
    * mate 2 needs >= 2 urls **and** >= 2 md5s; its size may be null;
    * files beyond the second are ignored.
    """
    if filters:
        df = df.where(regex_keep("sample_title", "run_accession", **filters))
    keep = downloadable("fastq_ftp", "fastq_md5")
    if pe_only:
        keep = keep & is_paired("fastq_ftp")
    df = df.where(keep)
    urls = packed_list("fastq_ftp")
    md5s = packed_list("fastq_md5")
    sizes = size_list("fastq_bytes", aligned=aligned_sizes)
    staged = df.select(
        "run_accession", F.coalesce(F.col("sample_title"), F.lit("")).alias("sample_title"),
        urls.alias("_urls"), md5s.alias("_md5s"), sizes.alias("_sizes"))
    mate2 = (F.size("_urls") >= 2) & (F.size("_md5s") >= 2)
    u1 = F.get(F.col("_urls"), 0)
    u2 = F.when(mate2, F.get(F.col("_urls"), 1))
    return staged.select(
        "run_accession",
        u1.alias("fastq_ftp_1_url"),
        u2.alias("fastq_ftp_2_url"),
        basename(u1).alias("fastq_ftp_1_name"),
        basename(u2).alias("fastq_ftp_2_name"),
        F.get(F.col("_md5s"), 0).alias("fastq_md5_1"),
        F.when(mate2, F.get(F.col("_md5s"), 1)).alias("fastq_md5_2"),
        F.coalesce(F.get(F.col("_sizes"), 0), F.lit(0).cast("decimal(20,0)")).alias("fastq_bytes_1"),
        F.when(mate2, F.get(F.col("_sizes"), 1)).alias("fastq_bytes_2"),
        "sample_title",
    )


def normalize_report(df: DataFrame, extra: dict | None = None) -> DataFrame:
    """Project any frame onto the 49 report columns: absent ones become null,
    the four defaulted ones become ``''`` when null.  ``extra`` maps further
    output names to Columns of ``df``."""
    have = set(df.columns)
    cols = []
    for c in RUN_REPORT_COLUMNS:
        v = F.col(c).cast("string") if c in have else F.lit(None).cast("string")
        if c in RUN_REPORT_DEFAULT_EMPTY:
            v = F.coalesce(v, F.lit(""))
        cols.append(v.alias(c))
    cols += [v.alias(k) for k, v in (extra or {}).items()]
    return df.select(*cols)


def union_reports(*dfs: DataFrame) -> DataFrame:
    """Concatenate reports by column name; columns one side lacks are null."""
    out = None
    for d in dfs:
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def run_total_bytes(processed: DataFrame) -> Column:
    """Bytes of both mates of a processed run (a missing mate 2 counts 0)."""
    return (F.col("fastq_bytes_1") + F.coalesce(F.col("fastq_bytes_2"), F.lit(0).cast("decimal(20,0)")))


def capacity_plan(processed: DataFrame, factor: float = FASTQ_EXPANSION) -> DataFrame:
    """One row with the number of runs, planned bytes and the FASTQ
    expansion estimate (``factor`` x the archive bytes)."""
    b = run_total_bytes(processed)
    return processed.agg(
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.sum(b), F.lit(0)).cast("decimal(38,0)").alias("planned_bytes"),
        (F.coalesce(F.sum(b), F.lit(0)).cast("double") * F.lit(float(factor))).alias("expanded_bytes"),
    )


def study_rollup(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run counts per key combination with ROLLUP subtotals; ``level`` is
    the grouping id (0 = most detailed)."""
    return (runs.rollup(*keys)
            .agg(F.count(F.lit(1)).alias("runs"), F.grouping_id().alias("level")))
