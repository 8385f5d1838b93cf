"""Sharding along a Hilbert curve.

Each metadata dimension is quantised to ``BITS`` bits by rank: a value's cell
is the share of rows with smaller values, so the cells hold about equally many
rows whatever the values' type or spread, and equal values share a cell.  The
cells' place on the Hilbert curve orders the rows (ties by id, then by the
text's checksum and size), and the order is cut into runs of near equal bytes.
Rows close on the curve are close in every dimension, so a run's minima and
maxima are tight in all of them and a filter on any dimension skips files.

The law that holds is ``bytes``: a row belongs to the run in which the middle
of its bytes falls, so a cut is off by at most half a row.

All of it is DataFrame expressions.  The order comes from a range partitioning
with running totals per partition (``ordered``), never from a one-task window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_no, numbered, ordered, stored

BITS, SHARDS = 5, 8


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a cell, given its coordinates (0 .. 2^bits - 1),
    by rotating and reflecting the cube bit by bit from the top (Skilling's transform)."""
    n = len(cells)
    xor = lambda a, b: a.bitwiseXOR(b)

    def turned(i: int, bit: Column):
        """Reflect the first axis if axis i has the bit, else exchange the two below the bit."""
        def step(x: Column) -> Column:
            has = x[i].bitwiseAND(bit) != 0
            swap = F.when(has, F.lit(0).cast("long")).otherwise(xor(x[0], x[i]).bitwiseAND(bit - 1))
            first = xor(x[0], F.when(has, bit - 1).otherwise(swap))
            # The first axis with itself: nothing to exchange.
            return F.array(first, *[xor(x[j], swap) if j == i else x[j] for j in range(1, n)])
        return step

    def undo(axes: Column, bit: Column) -> Column:
        for i in range(n):
            axes = F.transform(F.array(axes), turned(i, bit))[0]  # as a lambda's argument it is evaluated once, used often
        return axes

    levels = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
    start = F.array(*[c.cast("long") for c in cells])
    axes = F.aggregate(levels, start, undo) if bits > 1 else start

    def gray(x: Column) -> Column:
        running = [x[0]]
        for j in range(1, n):
            running.append(xor(running[-1], x[j]))
        return F.array(*running)

    axes = F.transform(F.array(axes), gray)[0]

    def place(x: Column) -> Column:
        flips = [F.when(x[n - 1].bitwiseAND(F.lit(1 << b).cast("long")) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)).cast("long")
                 for b in range(bits - 1, 0, -1)]
        flip = F.lit(0).cast("long")
        for f in flips:
            flip = xor(flip, f)
        return F.transform(F.array(flip), lambda t: F.array(*[xor(x[j], t) for j in range(n)]))[0]

    axes = F.transform(F.array(axes), place)[0]
    read_out = lambda x: sum((F.shiftleft(F.shiftright(x[j], b).bitwiseAND(F.lit(1).cast("long")), b * n + n - 1 - j)
                              for b in range(bits) for j in range(n)), F.lit(0).cast("long"))
    return F.transform(F.array(axes), read_out)[0]


def _cell(rows: DataFrame, dim: str, n_rows: int, bits: int) -> Column:
    """floor(2^bits * share of rows with a smaller value), nulls being largest, as
    an expression: the first value of each cell (at most 2^bits of them) is all it needs."""
    counts = stored(rows.groupBy(dim).agg(F.count("*").alias("n")), "hilbert-counts")
    below = ordered(counts, [dim], {"below": "n"}, "hilbert-below")
    cell = F.floor(F.col("below") * (1 << bits) / F.lit(n_rows))
    cuts = below.select(cell.alias("cell"), F.isnull(dim).alias("none"), dim).groupBy("cell", "none").agg(F.min(dim).alias("low")).collect()
    out = F.when(F.isnull(dim), F.lit(max((r["cell"] for r in cuts if r["none"]), default=0)))
    for r in sorted((r for r in cuts if not r["none"]), key=lambda r: -r["cell"]):
        out = out.when(F.col(dim) >= F.lit(r["low"]), F.lit(r["cell"]))
    return out.otherwise(F.lit(0)).cast("long")


def runs(rows: DataFrame, dims: list[str], ties: list[str], size: str, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``rows`` with hilbert, shard and slot: the row's place on the curve, its run of
    near equal total ``size``, and its place in the run."""
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    rows = rows.withColumn("hilbert", hilbert_index([_cell(rows, d, max(n_rows, 1), bits) for d in dims], bits))
    rows = ordered(rows, ["hilbert", *ties], {"before": size}, "hilbert-order")
    middle = (F.col("before") * 2 + F.col(size)).cast("decimal(38,0)") * shards
    shard = F.least(F.floor(middle / F.lit(max(2 * total, 1)).cast("decimal(38,0)")), F.lit(shards - 1)).cast("int")
    rows = rows.withColumn("shard", shard)
    first = rows.groupBy("shard").agg(F.min("pos").alias("first"))  # one row per shard
    return rows.join(F.broadcast(first), "shard").withColumn("slot", F.col("pos") - F.col("first")).drop("pos", "before", "first")


def shard_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims=("lang", "source", "n_chars"),
                shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """(id, size, text_crc32, hilbert, shard, slot) for every row of ``docs``.

    Size is the text's UTF-8 bytes plus 1 (null text: 1).  Rows of equal texts are
    spread as their metadata and ids say, not kept together.  Null ids and dimensions
    come last in their order; repeated rows get a slot each.  A run may be empty if
    single rows are longer than a shard.
    """
    text = F.col(column_no(docs, text_col)).cast("binary")
    rows = numbered(docs).select(
        F.col(column_no(docs, id_col)).alias("id"), F.coalesce(F.octet_length(text).cast("long") + 1, F.lit(1).cast("long")).alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"), *[F.col(column_no(docs, d)).alias(f"dim_{d}") for d in dims])
    rows = stored(rows, "hilbert-rows")
    return runs(rows, [f"dim_{d}" for d in dims], ["id", "text_crc32", "size"], "size", shards, bits)


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims=("lang", "source", "n_chars"),
                    shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` with hilbert, shard and slot added, in the order of the
    curve: each file that is written holds a stretch of it.  Added columns of a name that ``docs`` has
    already get a trailing underscore."""
    text = F.col(column_no(docs, text_col)).cast("binary")
    rows = numbered(docs).withColumns({
        "id": F.col(column_no(docs, id_col)), "size": F.coalesce(F.octet_length(text).cast("long") + 1, F.lit(1).cast("long")),
        "text_crc32": F.crc32(F.coalesce(text, F.lit(b"")))} | {f"dim_{d}": F.col(column_no(docs, d)) for d in dims})
    out = runs(rows, [f"dim_{d}" for d in dims], ["id", "text_crc32", "size"], "size", shards, bits)
    taken, names = {c.lower() for c in docs.columns}, []
    for c in ("hilbert", "shard", "slot"):
        while c in taken:
            c += "_"
        names.append(c)
    return out.select(*[f"c{i}" for i in range(len(docs.columns))], "hilbert", "shard", "slot").toDF(*docs.columns, *names)
