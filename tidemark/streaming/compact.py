"""Compaction of stream sinks.

A sink of :func:`run_stream` grows by a ``batch_id=<n>`` folder per batch, and
its current state is the newest row per key over all of them.  :func:`compact`
merges the folders up to a batch, and the snapshot before, into the next
snapshot, and then writes a pointer to it.  Readers take the newest pointer's
snapshot and the batches after it.

Everything is written to new folders and a pointer counts only once its write
has committed, so a run that ends early leaves the former state valid; the next
one overwrites what it left.  A batch that is replayed writes the same rows to
its own folder, whether or not it is part of a snapshot by then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _side(sink: str, what: str) -> str:
    return f"{sink.rstrip('/')}.compacted/{what}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _versions(spark: SparkSession, sink: str) -> list[int]:
    """Versions whose pointer has been committed (one folder each, listed by name)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(_side(sink, "pointers"))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version=") and _exists(spark, f"{_side(sink, 'pointers')}/{n}/_SUCCESS"))


def pointer(spark: SparkSession, sink: str) -> tuple[int, int] | None:
    """(version, last batch in it) of the current snapshot, or None."""
    found = _versions(spark, sink)
    if not found:
        return None
    return found[-1], spark.read.parquet(f"{_side(sink, 'pointers')}/version={found[-1]}").first()["upto"]


def _newest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cols = [c for c in df.columns if c not in keys and c != "batch_id"]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("_r"), F.max("batch_id").alias("batch_id"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols], "batch_id")


def _parts(spark: SparkSession, sink: str, upto: int | None = None) -> DataFrame:
    """Rows of the current snapshot and of the batches after it (up to one), with their batch_id."""
    now, rows = pointer(spark, sink), None
    p = spark._jvm.org.apache.hadoop.fs.Path(sink)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    ids = sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch_id="))
    ids = [i for i in ids if (now is None or i > now[1]) and (upto is None or i <= upto)]
    if ids:
        rows = spark.read.option("basePath", sink).parquet(*[f"{sink.rstrip('/')}/batch_id={i}" for i in ids])
        rows = rows.withColumn("batch_id", F.col("batch_id").cast("long"))
    if now is not None:
        snapshot = spark.read.parquet(f"{_side(sink, 'snapshots')}/version={now[0]}")
        rows = snapshot if rows is None else rows.unionByName(snapshot)
    if rows is None:
        raise ValueError(f"no batch in {sink}")
    return rows


def compact(spark: SparkSession, sink: str, keys: Sequence[str], upto: int) -> int:
    """Merge the batches up to ``upto`` (which must be complete) into a new snapshot
    and point to it; returns its version.  Nothing is done if ``upto`` is in one already."""
    now = pointer(spark, sink)
    if now is not None and now[1] >= upto:
        return now[0]
    version = 0 if now is None else now[0] + 1
    _newest(_parts(spark, sink, upto), keys).write.mode("overwrite").parquet(f"{_side(sink, 'snapshots')}/version={version}")
    spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("overwrite").parquet(f"{_side(sink, 'pointers')}/version={version}")
    return version


def read_current(spark: SparkSession, sink: str, keys: Sequence[str]) -> DataFrame:
    """The newest row per key: one snapshot and the batches after it."""
    return _newest(_parts(spark, sink), keys).drop("batch_id")
