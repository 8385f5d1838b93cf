"""File sinks K1-K7.  Every writer is a distributed DataFrame write: no
``collect``, no single-task output.  Orders that matter (manifests, gzip line
order) are produced by range-partitioned sorts, so part files are in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import basename
from ..operators.checksum import manifest_line
from ..operators.runs import normalize_report
from .tables import encrypt_json, failed_volume_lines, mate_checksum_rows, progress_json, \
    random_nonce, submission_rows


def write_run_report(df: DataFrame, out_dir: str, accession: str | None = None,
                     mode: str = "overwrite") -> str:
    """K1: 49-column TSV with header, nulls written as empty fields.

    The optional ``# Project Accession: X`` line cannot precede a CSV header in
    a distributed write, so it goes to the sibling folder ``<path>_accession``;
    the reader (S1) skips ``#`` lines either way.
    """
    path = f"{out_dir.rstrip('/')}/{accession}_metadata" if accession else out_dir
    (normalize_report(df).write.mode(mode)
     .option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "")
     .option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
    if accession:
        spark = df.sparkSession
        spark.createDataFrame([(f"# Project Accession: {accession}",)], "value string") \
            .coalesce(1).write.mode("overwrite").text(path + "_accession")
    return path


def write_run_reports(df: DataFrame, out_dir: str, accession: str = "accession", mode: str = "overwrite") -> str:
    """K1 for many accessions in one distributed write: one folder per
    accession (``<out>/accession=<X>/part-*.csv``), 49 columns each.  Read
    back with ``read_accession_reports(spark, out, pattern=ACCESSION_DIR)``."""
    # range partition on (accession, run): balanced writer tasks even when one
    # accession holds most runs, while each accession still lands in few files
    # (no number is given: adaptive execution sizes the tasks by the data)
    (normalize_report(df, extra={accession: F.col(accession)})
     .repartitionByRange(accession, "run_accession").write.mode(mode)
     .partitionBy(accession)
     .option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "")
     .option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(out_dir))
    return out_dir


ACCESSION_DIR = r"accession=([^/]+)/[^/]*$"


def write_mate_checksums(processed: DataFrame, out_dir: str, accession: str, mode: str = "overwrite") -> tuple[str, str]:
    """K2: ``R1_fastq_md5_<acc>.tsv`` and ``R2_...`` (no header): md5, name, title."""
    rows = mate_checksum_rows(processed)  # two narrow passes cost less than keeping the rows
    paths = []
    for mate in (1, 2):
        p = f"{out_dir.rstrip('/')}/R{mate}_fastq_md5_{accession}.tsv"
        (rows.where(F.col("mate") == mate).select("md5", "filename", "sample_title")
         .write.mode(mode).option("sep", "\t").option("header", False).option("emptyValue", "").csv(p))
        paths.append(p)
    return paths[0], paths[1]


def write_manifest(files: DataFrame, out_path: str, md5: str = "md5", path: str = "path",
                   mode: str = "overwrite") -> str:
    """K3: md5sum-style manifest ordered by full path (global range sort)."""
    named = files.select(F.col(path).alias("path"), manifest_line(F.col(md5), basename(F.col(path))).alias("line"))
    named.orderBy("path").select("line").write.mode(mode).text(out_path)
    return out_path


def write_failed_volumes(failures: DataFrame, out_path: str, stamp: str, database: str,
                         mode: str = "overwrite") -> str:
    """K4: header lines, then per volume its name, error and uris."""
    failed_volume_lines(failures, stamp, database).orderBy("sort_key").select("line") \
        .write.mode(mode).text(out_path)
    return out_path


def write_submission_template(files: DataFrame, out_path: str, bucket: str, prefix: str | None,
                              path: str = "path", mode: str = "overwrite") -> str:
    """K5: TSV with the 12-column submission header."""
    submission_rows(files, bucket, prefix, path).write.mode(mode) \
        .option("sep", "\t").option("header", True).option("emptyValue", "").csv(out_path)
    return out_path


def export_progress(progress: DataFrame, out_path: str | None = None, key_hex: str | None = None,
                    mode: str = "overwrite") -> DataFrame:
    """K6: progress as JSON lines, optionally AES-256-GCM encrypted per line
    (base64 ciphertext and base64 12-byte nonce in separate columns)."""
    j = progress_json(progress)
    if key_hex:
        j = j.withColumn("_nonce", random_nonce())
        j = j.select("run_id", encrypt_json(F.col("json"), key_hex, F.col("_nonce")).alias("ciphertext"),
                     F.base64("_nonce").alias("nonce"))
    if out_path:
        j.write.mode(mode).json(out_path)
    return j


def write_gzip_text(lines: DataFrame, out_dir: str, file_col: str = "file", line_no: str = "line_no",
                    text: str = "line", mode: str = "overwrite") -> str:
    """K7: gzip text per output file (``file=<name>/part-*.gz``).

    Range partitioning on (file, line_no) splits a large file over several
    tasks; each writes an ordered gzip member and the part files are in line
    order, so reading the directory restores the file.  Missing or empty files
    simply have no rows.  Sources are never deleted.
    """
    (lines.repartitionByRange(file_col, line_no).sortWithinPartitions(file_col, line_no)
     .select(F.col(file_col).alias("file"), F.col(text).alias("value"))
     .write.mode(mode).partitionBy("file").option("compression", "gzip").text(out_dir))
    return out_dir


def gzip_text_files(spark, paths: str, out_dir: str, mode: str = "overwrite") -> str:
    """K7 for files: re-compress text files (e.g. ``X.fastq``, ``X_1.fastq``,
    ``X_2.fastq`` of a run) into ``out_dir/file=<name>/part-*.gz``.  Lines are
    numbered without gathering a file into one task; missing or empty files
    produce nothing; sources are never deleted."""
    from ..sources.text import read_numbered_lines
    lines = read_numbered_lines(spark, paths, line_sep="\n").select(
        F.substring_index("file", "/", -1).alias("file"), "line_no", F.col("value").alias("line"))
    return write_gzip_text(lines, out_dir, mode=mode)
