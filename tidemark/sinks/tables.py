"""Sink-shaped tables (the rows a sink writes), kept separate from the writers
so they can be checked as DataFrames: K2, K3, K4, K5, K6, K8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import basename, file_type, upload_key
from ..schemas import PROGRESS_MAP, SUBMISSION_COLUMNS


def dry_run_plan(processed: DataFrame) -> DataFrame:
    """K8: per run the file name and size; mate 2 only when name **and** size."""
    m1 = F.struct(F.lit(1).alias("mate"), F.col("fastq_ftp_1_name").alias("filename"),
                  F.col("fastq_bytes_1").alias("size"))
    m2 = F.struct(F.lit(2).alias("mate"), F.col("fastq_ftp_2_name").alias("filename"),
                  F.col("fastq_bytes_2").alias("size"))
    return (processed.select("run_accession", F.explode(F.filter(
        F.array(m1, m2), lambda t: t["filename"].isNotNull() & t["size"].isNotNull())).alias("t"))
        .select("run_accession", "t.*"))


plan_report = dry_run_plan  # K8 name used in the operator inventory


def listing_plan(objects: DataFrame, human: bool = True) -> DataFrame:
    """K8 (public data): key and size of every object that would be fetched,
    with the size in binary units when ``human``."""
    from ..functions.columns import human_bytes
    cols = [c for c in ("name", "key", "size") if c in objects.columns]
    out = objects.select(*cols)
    return out.withColumn("size_text", human_bytes("size")) if human else out


def mate_checksum_rows(processed: DataFrame) -> DataFrame:
    """K2: rows of the R1/R2 checksum TSVs (md5, name, sample_title); the
    mate-2 row only when its md5 **and** name exist."""
    m1 = F.struct(F.lit(1).alias("mate"), F.col("fastq_md5_1").alias("md5"),
                  F.col("fastq_ftp_1_name").alias("filename"))
    m2 = F.struct(F.lit(2).alias("mate"), F.col("fastq_md5_2").alias("md5"),
                  F.col("fastq_ftp_2_name").alias("filename"))
    return (processed.select("sample_title", F.explode(F.filter(
        F.array(m1, m2), lambda t: t["md5"].isNotNull() & t["filename"].isNotNull())).alias("t"))
        .select("t.mate", "t.md5", "t.filename", "sample_title"))


def failed_volume_lines(failures: DataFrame, stamp: str, database: str) -> DataFrame:
    """K4: the failed-volumes manifest as ordered lines (``sort_key`` orders
    them): a header with the total and a blank line, then per volume its name,
    its error, its uris (none for a volume without objects) and a blank line.
    ``failures`` has one row per (volume, uri) with the error text; the header
    carries the stamp passed in, so runs are repeatable."""
    key = lambda h, v, kind, uri: F.struct(
        F.lit(h).alias("h"), v.alias("volume"), F.lit(kind).alias("kind"), uri.alias("uri"))
    none = F.lit("")
    vols = failures.groupBy("volume").agg(F.min("error").alias("error"))
    header = vols.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(
        F.struct(key(0, none, 0, none).alias("sort_key"), F.lit(f"# Failed volumes for {database}").alias("line")),
        F.struct(key(0, none, 1, none).alias("sort_key"), F.lit(f"# Generated at {stamp}").alias("line")),
        F.struct(key(0, none, 2, none).alias("sort_key"), F.format_string("# Total: %d", "n").alias("line")),
        F.struct(key(0, none, 3, none).alias("sort_key"), none.alias("line")))).alias("x")).select("x.*")
    v = F.col("volume")
    blocks = vols.select(F.explode(F.array(
        F.struct(key(1, v, 0, none).alias("sort_key"), F.format_string("[volume: %s]", v).alias("line")),
        F.struct(key(1, v, 1, none).alias("sort_key"), F.concat(F.lit("# error: "), F.coalesce("error", none)).alias("line")),
        F.struct(key(1, v, 3, none).alias("sort_key"), none.alias("line")))).alias("x")).select("x.*")
    uris = failures.where(F.col("uri").isNotNull()).select(key(1, v, 2, F.col("uri")).alias("sort_key"), F.col("uri").alias("line"))
    return header.unionByName(blocks).unionByName(uris)


def submission_rows(files: DataFrame, bucket: str, prefix: str | None, path: str = "path") -> DataFrame:
    """K5: filename, filetype, nine blanks, s3_path."""
    name = basename(F.col(path))
    key = upload_key(F.lit(prefix) if prefix is not None else F.lit(None).cast("string"), name)
    cols = {"filename": name, "filetype": file_type(name),
            "s3_path": F.concat(F.lit(f"s3://{bucket}/"), key)}
    return files.select(*[(cols[c] if c in cols else F.lit("")).alias(c) for c in SUBMISSION_COLUMNS])


def progress_json(progress: DataFrame) -> DataFrame:
    """K6: one JSON object per run, ``{"<run_id>": {...}}``.  Concatenated they
    are the progress map; no single row ever holds the whole store."""
    entry = F.struct(*[F.col(f.name) for f in PROGRESS_MAP.valueType.fields])
    return progress.select("run_id", F.to_json(F.create_map(F.col("run_id"), entry)).alias("json"))


def encrypt_json(json_col: Column, key_hex: str, nonce: Column) -> Column:
    """K6 encryption: AES-256-GCM under ``nonce`` (12 random bytes, made once
    per row by the caller).  Spark's output is nonce || ciphertext || tag;
    returns base64(ciphertext || tag)."""
    enc = F.aes_encrypt(json_col.cast("binary"), F.unhex(F.lit(key_hex)), F.lit("GCM"), F.lit("DEFAULT"), nonce)
    return F.base64(F.substring(enc, 13, 1 << 30))


def random_nonce() -> Column:
    """12 random bytes per row (non-deterministic, so Spark evaluates it once)."""
    return F.unhex(F.substring(F.sha2(F.expr("uuid()"), 256), 1, 24))
