"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import scratch_path

# Rows above which a lookup table is joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 100_000
# Bytes of one Arrow batch handed to Python: long texts travel in smaller batches.
ARROW_BATCH_BYTES = 4 << 20
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of these exact names, whatever other columns ``df`` has
    (also ones whose names differ by case only, or repeat)."""
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    return numbered(df).select(*[F.col(f"c{at[n]}").alias(n) for n in names])


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns renamed c0, c1, ... by position; ``numbered(df).toDF(*df.columns)`` undoes it."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def column_no(df: DataFrame, name: str) -> str:
    """The name that ``numbered`` gives to the first column called exactly ``name``."""
    return f"c{df.columns.index(name)}"


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows, unless the session already does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not now or not now.isdigit() or int(now) > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: it is computed
    once, and later stages do not depend on the executors that computed it."""
    path = scratch_path(df.sparkSession, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(big: DataFrame, small: DataFrame, on: list[str], how: str = "left",
           limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a lookup table: by broadcast when a count proves it has at most
    ``limit`` rows, else by a shuffle whose hot partitions adaptive execution
    splits.  ``small`` should be stored, as it is counted first."""
    if small.limit(limit + 1).count() <= limit:
        small = F.broadcast(small)
    return big.join(small, on, how)


def ordered(df: DataFrame, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """``df`` in global order with running totals, without a one-task window.

    Adds ``pos`` (rows before this one, from 0) and for each ``sums`` item
    (new column: long column) the total over the rows before this one.  The rows
    are range-partitioned on ``order`` and totalled inside each partition; the
    partitions' own totals (one row each) are carried forward to the next.
    ``order`` should tell rows apart: rows equal in all of it stay in one
    partition.  Nulls come last.
    """
    keys = [k for c in order for k in (F.isnull(c), F.col(c))]
    piece = df.repartitionByRange(*keys).withColumn("piece", F.spark_partition_id())
    w = Window.partitionBy("piece").orderBy(*keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.select("*", (F.row_number().over(w).cast("long") - 1).alias("pos"),
                         *[F.coalesce(F.sum(c).over(before), F.lit(0).cast("long")).alias(n) for n, c in sums.items()])
    piece = stored(piece, name)
    ends = piece.groupBy("piece").agg(F.count("*").alias("n0"), *[F.sum(c).alias(f"n_{n}") for n, c in sums.items()])
    # One row per partition: its number is the session's setting, not the data's.
    w = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("piece", *[F.coalesce(F.sum(c).over(w), F.lit(0).cast("long")).alias(f"at_{c}")
                                  for c in ["n0", *[f"n_{n}" for n in sums]]])
    out = piece.join(F.broadcast(ends), "piece")
    return (out.withColumn("pos", F.col("pos") + F.col("at_n0"))
            .withColumns({n: F.col(n) + F.col(f"at_n_{n}") for n in sums})
            .drop("piece", "at_n0", *[f"at_n_{n}" for n in sums]))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an undirected graph: (node, root), ``root`` the
    smallest node reachable, for every node that has an edge to another.

    ``edges`` has long columns a, b.  Large-star and small-star steps alternate
    until the edges no longer change; each step hangs nodes on their smallest
    neighbour, so chains shorten by a factor each round.  Neighbour minima are
    aggregated before the join, and each round is a table in the shared folder.
    """
    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = stored(e, name)
    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        big = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = (big.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        e = stored(small, name)
        now = mark(e)
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    flat = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(F.length(flat) > 0, F.size(F.split(flat, " +"))).otherwise(0).cast("long")
