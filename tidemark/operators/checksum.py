"""Checksums: X15 content md5, J1 manifest verify, A1 summary, J8 integrity,
J10 reconciliation, K3 manifest rows.

Joins are on file names after one partial-aggregating group-by per side, so a
name that occurs many times never fans out into pairs.
"""

from __future__ import annotations

import hashlib
import re
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import basename, canonical_path
from .filters import drop_artifacts

# The file reader runs in Spark's Python workers, which need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

READ_BLOCK = 1 << 20  # 1 MiB reads for large files


def content_md5(df: DataFrame, content: str = "content") -> DataFrame:
    """X15 for content held in a column (text or binary): lower-case hex md5."""
    return df.withColumn("actual_md5", F.md5(F.col(content)))


def _open(path: str):
    if path.startswith("file:"):
        return open(path[5:] if not path.startswith("file://") else path[7:], "rb")
    if "://" in path:
        from pyarrow import fs as pafs
        # Hadoop's names of the object store are not known outside the JVM
        f, p = pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
        return f.open_input_stream(p)
    return open(path, "rb")


def _md5_paths(batches):
    """(path, length) -> (path, length, actual_md5).  A file that cannot be read
    fails the task, as it does for files hashed in the JVM."""
    for pdf in batches:
        out = []
        for p in pdf["path"]:
            h = hashlib.md5()
            with _open(p) as f:
                while b := f.read(READ_BLOCK):
                    h.update(b)
            out.append(h.hexdigest())
        yield pdf.assign(actual_md5=out)


def file_md5(spark, root: str, max_inline_bytes: int = 64 << 20) -> DataFrame:
    """X15 for a directory tree -> (path, length, actual_md5), S6 rules applied.

    Files up to ``max_inline_bytes`` are hashed in the JVM (``md5(content)``;
    the binary-file source applies the ``length`` filter before it reads any
    content).  Larger files are hashed by path with streaming 1 MiB reads: an
    md5 cannot be split, so one large file is one task, and the large-file list
    is spread over tasks.  Either way an unreadable file fails the job."""
    from ..sources.manifest import filter_inventory
    src = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = (src.where(F.col("length") <= max_inline_bytes)
             .select("path", "length", F.md5("content").alias("actual_md5")))
    large = (src.where(F.col("length") > max_inline_bytes).select("path", "length")
             .repartition(max(1, spark.sparkContext.defaultParallelism), "path")
             .mapInPandas(_md5_paths, "path string, length long, actual_md5 string"))
    both = small.unionByName(large).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    local_root = re.sub(r"^file:/*", "/", root)
    return filter_inventory(both, local_root).drop("rel_path")


def verify_manifest_at(entries: DataFrame, files: DataFrame, root: str, manifest_path: str | None = None,
                       filename: str = "filename", path: str = "path") -> DataFrame:
    """J1 as the tool does it: each entry names a file relative to ``root``
    (an absolute entry stands for itself) and is checked against the file at
    that path -> OK / MISMATCH / MISSING.  Logs are skipped by the entry's file
    name in whatever folder, the manifest itself by its path.  ``files`` has one
    row per path (``path``, ``actual_md5``)."""
    at = F.when(F.startswith(filename, F.lit("/")), F.col(filename)).otherwise(
        F.concat(F.lit(root.rstrip("/") + "/"), filename))
    e = drop_artifacts(entries, name=filename, manifest_name=None).withColumn("_at", canonical_path(at))
    if manifest_path:
        e = e.where(F.col("_at") != canonical_path(F.lit(manifest_path)))
    f = files.groupBy(canonical_path(F.col(path)).alias("_at")).agg(F.min("actual_md5").alias("actual_md5"), F.count("*").alias("_n"))
    j = e.withColumn("expected_md5", F.lower(F.col("md5"))).join(f, "_at", "left")
    status = (F.when(F.col("_n").isNull(), F.lit("MISSING"))
              .when(F.col("actual_md5") == F.col("expected_md5"), F.lit("OK")).otherwise(F.lit("MISMATCH")))
    return j.select(F.col(filename), F.col("_at").alias("path"), "expected_md5", "actual_md5", status.alias("status"))


def verify_manifest(entries: DataFrame, actual: DataFrame, key: str = "filename",
                    manifest_name: str | None = None) -> DataFrame:
    """Every manifest entry -> OK / MISMATCH / MISSING (duplicates kept,
    extra files ignored, tool artifacts dropped first).  The expected md5 is
    lower-cased as the manifest parser does.  ``actual`` is reduced to one row
    per name first; a name found several times with different md5s is
    AMBIGUOUS instead of fanning out."""
    e = drop_artifacts(entries, name=key, manifest_name=manifest_name)
    a = actual.groupBy(F.col(key).alias(key)).agg(
        F.count(F.lit(1)).alias("copies"), F.min("actual_md5").alias("_lo"), F.max("actual_md5").alias("_hi"))
    j = e.withColumn("expected_md5", F.lower(F.col("md5"))).join(a, key, "left")
    status = (F.when(F.col("copies").isNull(), F.lit("MISSING"))
              .when((F.col("_lo") == F.col("expected_md5")) & (F.col("_hi") == F.col("expected_md5")), F.lit("OK"))
              .when(F.col("copies") > 1, F.lit("AMBIGUOUS"))
              .otherwise(F.lit("MISMATCH")))
    return j.select(key, "expected_md5", F.when(F.col("copies") == 1, F.col("_lo")).alias("actual_md5"),
                    F.coalesce(F.col("copies"), F.lit(0)).alias("copies"), status.alias("status"))


def verify_summary(verified: DataFrame) -> DataFrame:
    """A1: (passed, failed); missing counts as failed; empty input -> (0, 0)."""
    return verified.agg(F.count_if(F.col("status") == "OK").alias("passed"),
                        F.count_if(F.col("status") != "OK").alias("failed"))


def check_integrity(remote: DataFrame, local: DataFrame) -> DataFrame:
    """md5 known -> compare md5 as given (upper case fails); unknown ->
    size only.  A missing local file is invalid."""
    others = [c for c in local.columns if c != "file_id"]
    one = local.groupBy("file_id").agg(F.max(F.struct(*others)).alias("_l")).select("file_id", *[F.col(f"_l.{c}").alias(c) for c in others])
    j = remote.join(one, "file_id", "left")
    by_md5 = F.col("md5").isNotNull()
    valid = (F.when(F.col("local_size").isNull(), F.lit(False))
             .when(by_md5, F.coalesce(F.col("local_md5") == F.col("md5"), F.lit(False)))
             .otherwise(F.col("local_size") == F.col("size")))
    return j.select("file_id", F.when(by_md5, F.lit("md5")).otherwise(F.lit("size")).alias("method"),
                    valid.alias("valid"))


def reconcile(local: DataFrame, archive: DataFrame, key: str = "filename") -> DataFrame:
    """Local manifest vs archive md5 list -> matched / differs / conflict /
    archive_only / local_only (full outer join on the name, each side reduced to
    one row per name first).  A side that lists several md5s for one name is a
    conflict; its smallest md5 is shown."""
    def side(df: DataFrame, name: str) -> DataFrame:
        md5 = F.lower(F.col("md5"))
        return df.groupBy(key).agg(F.min(md5).alias(f"{name}_md5"), (F.min(md5) != F.max(md5)).alias(f"_{name}_many"),
                                   F.lit(True).alias(f"_{name}"))
    j = side(local, "local").join(side(archive, "archive"), key, "full_outer")
    status = (F.when(F.col("_local").isNull(), F.lit("archive_only"))
              .when(F.col("_archive").isNull(), F.lit("local_only"))
              .when(F.col("_local_many") | F.col("_archive_many"), F.lit("conflict"))
              .when(F.col("local_md5") == F.col("archive_md5"), F.lit("matched"))
              .otherwise(F.lit("differs")))
    return j.withColumn("status", status).drop("_local", "_archive", "_local_many", "_archive_many")


def manifest_rows(files: DataFrame, manifest_path: str | None = None, path: str = "path",
                  md5: str = "actual_md5") -> DataFrame:
    """K3 rows: ``md5<two spaces>basename`` for every file except the tool's
    logs and the manifest itself; ``path`` is kept as the sort key."""
    f = files.withColumn("_name", basename(F.col(path)))
    f = drop_artifacts(f, name="_name", manifest_name=None, path=path, manifest_path=manifest_path)
    return f.select(path, manifest_line(F.col(md5), F.col("_name")).alias("line"))


def manifest_line(md5: Column, name: Column) -> Column:
    """``md5<two spaces>name``; a file whose md5 is not known fails the job instead of writing a false line."""
    known = F.when(md5.isNull(), F.raise_error(F.concat(F.lit("no md5 for "), F.coalesce(name, F.lit("?")))).cast("string")).otherwise(md5)
    return F.concat(known, F.lit("  "), name)
