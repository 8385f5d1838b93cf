"""Line-numbered text scan.

``spark.read.text`` splits large files into blocks read by different tasks
and gives no line numbers.  The number of a line is recovered without
gathering a file into one task and without moving lines:

1. tag each line with its file, the start offset of its block
   (``_metadata.file_block_start``) and ``monotonically_increasing_id`` taken
   right after the scan (consecutive within a block);
2. count lines per (file, block) -- a partial-aggregating group-by, stored as
   a table of one row per block;
3. running sum of block counts per file over the *block* table (one row per
   block, tiny next to the data) gives each block's first line number;
4. a scan task holds few blocks, each a run of its ids: one broadcast row per
   task lists (first id of the block, line number to add), and a line looks up
   the last block that begins at or before its id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# Blocks whose numbers (16 bytes each) are broadcast; beyond that lines meet them by a join.
BROADCAST_BLOCKS = 4_000_000


def read_numbered_lines(spark: SparkSession, path: str, line_sep: str | None = None,
                        recursive: bool = False) -> DataFrame:
    """(file, line_no, value) for every line of the text files under ``path``;
    ``line_no`` is 1-based within each file."""
    r = spark.read
    if line_sep:
        r = r.option("lineSep", line_sep)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    raw = r.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_id"),
        "value")
    return number_lines(raw)


def number_lines(raw: DataFrame, max_broadcast: int = BROADCAST_BLOCKS) -> DataFrame:
    """Number lines of (file, _blk, _id, value) rows as described above.  Counts the
    blocks' lines first (one pass that reads no text into the shuffle)."""
    spark = raw.sparkSession
    path = scratch_path(spark, f"blocks-{uuid.uuid4().hex}")
    raw.groupBy("file", "_blk").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_id0")).write.parquet(path)
    blocks = spark.read.schema("file string, _blk long, _n long, _id0 long").parquet(path)
    w = Window.partitionBy("file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_add", F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_id0") + 1)
    if blocks.count() > max_broadcast:
        return raw.join(blocks.select("file", "_blk", "_add"), ["file", "_blk"]).select("file", (F.col("_id") + F.col("_add")).alias("line_no"), "value")
    # The upper bits of an id are its scan task.
    tasks = blocks.groupBy(F.shiftright("_id0", 33).alias("_task")).agg(F.array_sort(F.collect_list(F.struct("_id0", "_add"))).alias("_blocks"))
    found = raw.withColumn("_task", F.shiftright("_id", 33)).join(F.broadcast(tasks), "_task")
    own = F.when(F.size("_blocks") == 1, F.col("_blocks")[0]["_add"]).otherwise(
        F.aggregate("_blocks", F.lit(0).cast("long"), lambda a, b: F.when(b["_id0"] <= F.col("_id"), b["_add"]).otherwise(a)))
    return found.select("file", (F.col("_id") + own).alias("line_no"), "value")
