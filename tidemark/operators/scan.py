"""Ordered per-key scans that stay balanced when one key is huge.

``Window.partitionBy(key).orderBy(ts)`` puts every row of a key into one
task; if one feed holds a third of the data, that task is the whole job.
:func:`ordered_scan` computes the same running sums, row numbers and lags
with the key split across tasks:

1. ``repartitionByRange(n, key, order...)`` -- range bounds are sampled over
   (key, order), so a hot key is cut into many balanced, ordered pieces; each
   row is tagged with its piece (``spark_partition_id``).  The split is
   written once as a table in the shared checkpoint folder: both consumers
   below read it (one set of sampled bounds, the input computed once), and a
   lost executor reads the same pieces again;
2. a window over (piece, key) gives local results (groups are bounded by one
   range partition);
3. one small row per (key, piece) -- its totals and its last row -- and a
   window over pieces gives each piece its carry-in (sums of earlier pieces,
   last row of the previous piece);
4. an equi-join on (key, piece) adds the carry-in.

The per-(key, piece) table has at most ``n`` rows per key, so nothing grows
with the size of one key.  Equal (key, order) values never straddle pieces.

``split="auto"`` (default) first counts the rows of every key (partial
aggregation, a one-row result): when one key has more than
``spark.tidemark.scan.hotKeyRows`` rows (default 1,000,000) the input is cut
into pieces of about that many rows each.  Both ways give the same rows, null
keys and null values included.  ``spark.tidemark.scan.split`` = ``always`` /
``never`` overrides the count.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def _pieces(spark) -> int:
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover
        n = 200
    return max(n, spark.sparkContext.defaultParallelism)


HOT_KEY_ROWS = 1_000_000


def hot_pieces(df: DataFrame, keys: Sequence[str]) -> int:
    """Number of pieces to cut the input into, or 0 when no key has more rows
    than one task should sort alone.

    One partial-aggregating count per key (only the key columns are read),
    taken anew each time: the limit is absolute, and the pieces follow from the
    rows counted, not from the session's settings."""
    spark = df.sparkSession
    mode = spark.conf.get("spark.tidemark.scan.split", "auto")
    if mode == "never":
        return 0
    limit = int(spark.conf.get("spark.tidemark.scan.hotKeyRows", str(HOT_KEY_ROWS)))
    if mode == "always":
        return _pieces(spark)
    r = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.max("_n").alias("mx"), F.sum("_n").alias("tot")).first()
    mx, tot = (r["mx"] or 0), (r["tot"] or 0)
    return max(_pieces(spark), -(-tot // limit)) if mx > limit else 0


def has_hot_key(df: DataFrame, keys: Sequence[str]) -> bool:
    """True when one key holds more rows than one task should sort alone."""
    return hot_pieces(df, keys) > 0


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (a null key is a group
    like any other in the window path, so it must be one here too)."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence, sums: dict | None = None,
                 lags: dict | None = None, row_number: str | None = None,
                 split: str | int = "auto") -> DataFrame:
    """Running sums, lags and row numbers per key in ``order``.

    ``sums``   {out: Column} inclusive running sum of the expression;
    ``lags``   {out: column name} value of that column on the previous row;
    ``row_number`` output name for the 1-based position within the key.
    ``order`` items are column names (ascending) -- they must give a total
    order within a key for lags/row numbers to be deterministic.
    ``split``  number of pieces to cut the input into (0: plain window;
    True: the session's number of partitions); "auto": :func:`hot_pieces`.
    A running sum is null until the key's first non-null value.
    """
    keys, order = list(keys), list(order)
    sums, lags = dict(sums or {}), dict(lags or {})
    if split == "auto":
        split = hot_pieces(df, keys)
    if not split:
        w = Window.partitionBy(*keys).orderBy(*order)
        wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = df
        for name, expr in sums.items():
            out = out.withColumn(name, F.sum(expr).over(wr))
        for name, col in lags.items():
            out = out.withColumn(name, F.lag(col).over(w))
        if row_number:
            out = out.withColumn(row_number, F.row_number().over(w).cast("long"))
        return out
    if row_number:
        sums[row_number] = F.lit(1).cast("long")
    base = df
    for name, expr in sums.items():
        base = base.withColumn(f"_s_{name}", expr)
    spark = df.sparkSession
    n = _pieces(spark) if split is True else int(split)
    path = scratch_path(spark, f"scan-{uuid.uuid4().hex}")
    cut = base.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id())
    cut.write.parquet(path)
    r = spark.read.schema(cut.schema).parquet(path)
    w = Window.partitionBy("_pid", *keys).orderBy(*order)
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name in sums:
        r = r.withColumn(f"_l_{name}", F.sum(f"_s_{name}").over(wr))
    for name, col in lags.items():
        r = r.withColumn(f"_g_{name}", F.lag(col).over(w))
    if lags:
        r = r.withColumn("_first", F.row_number().over(w) == 1)
    aggs = [F.sum(f"_s_{name}").alias(f"_t_{name}") for name in sums]
    if lags:
        last_cols = sorted(set(lags.values()))
        aggs.append(F.max_by(F.struct(*[F.col(c) for c in last_cols]), F.struct(*[F.col(c) for c in order]))
                    .alias("_last"))
    piece = r.groupBy(*keys, "_pid").agg(*aggs)
    w2 = Window.partitionBy(*keys).orderBy("_pid")
    carry = piece
    for name in sums:
        carry = carry.withColumn(f"_o_{name}", F.sum(f"_t_{name}").over(w2.rowsBetween(Window.unboundedPreceding, -1)))
    if lags:
        carry = carry.withColumn("_prev", F.lag("_last").over(w2))
    carry = carry.select(*keys, "_pid", *[f"_o_{name}" for name in sums], *(["_prev"] if lags else []))
    j = join_null_safe(r, carry, [*keys, "_pid"])
    for name in sums:
        # null only where neither the carry nor the piece has seen a value yet
        j = j.withColumn(name, F.coalesce(F.col(f"_l_{name}") + F.col(f"_o_{name}"), f"_l_{name}", f"_o_{name}"))
    for name, col in lags.items():
        j = j.withColumn(name, F.when(F.col("_first"), F.col("_prev")[col]).otherwise(F.col(f"_g_{name}")))
    drop = ["_pid", "_first", "_prev"] + [f"_{p}_{name}" for name in sums for p in ("s", "l", "o")] + \
        [f"_g_{name}" for name in lags]
    return j.drop(*[c for c in drop if c in j.columns])
