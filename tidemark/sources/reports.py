"""Delimited text with quoted fields, split over many tasks.

A record of a tab-separated file may go on over several lines inside quotes, so
whether a line begins a record depends on all lines before it.  A line changes
that state in one of few ways (outside -> outside or inside, inside -> outside or
inside), and such changes compose: they are put together per chunk of lines, the
chunks' (one row each) are carried forward, and every line then knows how it
begins.  No task needs more of a file than a chunk.

Most files hold no open quote at all.  One pass tells which do; only the lines
of those files are sorted by chunk, the others are parsed where they are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import fail_if
from ..session import scratch_path
from .text import read_numbered_lines

CHUNK_LINES = 65_536
BROADCAST_ROWS = 100_000

# A field: quoted (doubled quotes inside; what follows the closing quote belongs to it) or
# plain, in which a quote is just a character.
_QUOTED = r'"(?:[^"]++|"")*+"[^\t]*+'
_FIELDS = rf"(?:(?:{_QUOTED}|[^\"\t][^\t]*+|)\t)*+"
_OPEN = r'"(?:[^"]++|"")*+\z'
# A line that begins outside ends inside quotes; one that begins inside still is there at its end.
_OPENS = rf"\A{_FIELDS}{_OPEN}"
_STAYS = rf'\A(?:[^"]++|"")*+(?:\z|"[^\t]*+\t{_FIELDS}{_OPEN})'


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lookup(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join a stored lookup table, by broadcast if a count proves it small."""
    return big.join(F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small, on, how)


def _opens(value: Column) -> Column:
    """A line that begins outside quotes ends inside them (never a comment)."""
    return value.contains('"') & ~value.startswith("#") & value.rlike(_OPENS)


def _stays(value: Column) -> Column:
    return ~value.contains('"') | value.rlike(_STAYS)


def _after(df: DataFrame, part: list[str], order: str, out0: Column, out1: Column) -> DataFrame:
    """Compose state changes along ``order``: out0 / out1 say whether the state after
    a row is inside when it was outside / inside before.  Adds in0, in1, after0 and after1: the state
    before and after the row when the first row of ``part`` begins outside (0) or inside (1)."""
    w = Window.partitionBy(*part).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_flip": (out0 & ~out1).cast("int"), "_set": F.when(out0 == out1, out0.cast("int"))})
    df = df.withColumn("_flips", F.sum("_flip").over(upto))
    # What the last row that settles the state leaves, but for the flips since then.
    df = df.withColumn("_base", F.last(F.pmod(F.col("_set") + F.col("_flips"), F.lit(2)), True).over(upto))
    for s in (0, 1):
        df = df.withColumn(f"after{s}", F.pmod(F.coalesce("_base", F.lit(s)) + F.col("_flips"), F.lit(2)) == 1)
        df = df.withColumn(f"in{s}", F.lag(f"after{s}", 1, bool(s)).over(w))
    return df.drop("_flip", "_set", "_flips", "_base")


def _long_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (file, line_no, text) of files with open quotes, and the quotes that never
    close (file, line_no): the line that opens them.  ``line_no`` of a record is its last line's."""
    value = F.col("value")
    chunks = lines.withColumn("chunk", F.expr(f"line_no div {CHUNK_LINES}"))
    chunks = _stored(_after(chunks, ["file", "chunk"], "line_no", _opens(value), _stays(value)), "report-lines")
    opener = lambda s: F.max(F.when(~F.col(f"in{s}") & F.col(f"after{s}"), F.col("line_no"))).alias(f"opener{s}")
    ends = chunks.groupBy("file", "chunk").agg(F.max_by(F.struct("after0", "after1"), "line_no").alias("end"), opener(0), opener(1))
    ends = _after(ends.select("file", "chunk", "end.after0", "end.after1", "opener0", "opener1").withColumnsRenamed({"after0": "out0", "after1": "out1"}),
                  ["file"], "chunk", F.col("out0"), F.col("out1"))
    own = F.when(F.col("in0"), F.col("opener1")).otherwise(F.col("opener0"))
    before = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = _stored(ends.select("file", "chunk", F.col("in0").alias("inside"), F.col("after0").alias("left_inside"), own.alias("opener"),
                               F.max(own).over(before).alias("opened")), "report-chunks")
    last = ends.groupBy("file").agg(F.max_by("left_inside", "chunk").alias("left_inside"), F.max("opener").alias("line_no"))
    unclosed = _stored(last.where("left_inside").select("file", "line_no"), "report-unclosed")

    known = _lookup(chunks, ends.select("file", "chunk", "inside", "opened"), ["file", "chunk"], "left")
    begins, stops = [F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0")) for c in ("in", "after")]
    known = known.withColumns({"begins": begins, "stops": stops})
    short = known.where("not begins and not stops").select("file", "line_no", F.col("value").alias("text"))
    parts = known.where("begins or stops")
    w = Window.partitionBy("file", "chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    first = F.coalesce(F.last(F.when(~F.col("begins"), F.col("line_no")), True).over(w), F.col("opened"))
    parts = parts.withColumn("first", first)
    parts = _lookup(parts, unclosed.withColumnRenamed("line_no", "first"), ["file", "first"], "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n")
    long = parts.groupBy("file", "first").agg(F.max("line_no").alias("line_no"), text.alias("text"))
    return short.unionByName(long.select("file", "line_no", "text")), unclosed


def _fields(text: Column) -> Column:
    """The fields of a record's text, unquoted."""
    def plain(f: Column) -> Column:
        inside = F.replace(F.regexp_extract(f, r'\A"((?:[^"]++|"")*+)"', 1), F.lit('""'), F.lit('"'))
        return F.when(f.startswith('"'), F.concat(inside, F.regexp_extract(f, r'\A"(?:[^"]++|"")*+"([^\t]*+)\z', 1))).otherwise(f)

    # every match takes the tab before it, so empty fields are matches too
    cut = F.regexp_extract_all(F.concat(F.lit("\t"), text), F.lit(rf"\t({_QUOTED}|[^\t]*+)"), F.lit(1))
    return F.when(text.contains('"'), F.transform(cut, plain)).otherwise(F.split(text, "\t", -1))


def _trimmed(text: Column) -> Column:
    return F.when(text.endswith("\r"), F.left(text, F.length(text) - 1)).otherwise(text)


def read_tsv_by_header(spark: SparkSession, path: str, recursive: bool = False, mode: str = "fail",
                       columns: Sequence[str] | None = None, of_file: dict[str, Column] | None = None) -> DataFrame:
    """(file, line_no, row[, error, line]): the records of many TSV files, each mapped
    to the names in its own header; ``line_no`` is the record's last line.

    ``row`` is a map of all columns or, with ``columns``, a struct of those (null where a
    file has no such column): a record's fields are then taken by the places that its file's
    header gives, and only those that are used.  ``of_file`` adds columns that follow from
    ``file``; they are found once per file.

    Lines that start with ``#`` outside quotes are skipped, as are blank ones; fields may
    be quoted (tabs, newlines and doubled quotes inside).  Empty fields are null.  Bad
    records are ragged ones, those with a bare carriage return outside quotes, a quote
    that the file never closes (its record is everything from there on), and all records
    of a file whose header names a column twice.  ``mode='fail'`` fails the job on a bad
    record; ``'quarantine'`` keeps it with its ``error`` and its text as ``line``."""
    if mode not in ("fail", "quarantine"):
        raise ValueError("mode must be 'fail' or 'quarantine'")
    value = F.col("value")
    lines = read_numbered_lines(spark, path, line_sep="\n", recursive=recursive)
    kept = ~value.startswith("#") & ~value.isin("", "\r")
    # One pass: which files have open quotes, and the first record of those that have none.
    files = _stored(lines.groupBy("file").agg(F.bool_or(_opens(value)).alias("open"), F.min(F.when(kept, F.struct("line_no", "value"))).alias("head")), "report-files")
    heads = files.where("not open and head is not null").select("file", F.col("head.line_no").alias("head_no"), F.col("head.value").alias("head"))
    is_open = files.where("open").select("file")
    if is_open.limit(1).count():
        long, unclosed = _long_records(_lookup(lines, is_open, ["file"], "left_semi"))
        long = long.where(~F.col("text").startswith("#") & ~F.col("text").isin("", "\r"))
        records = _lookup(lines, is_open, ["file"], "left_anti").where(kept).select("file", "line_no", value.alias("text")).unionByName(long)
        head = long.groupBy("file").agg(F.min(F.struct("line_no", "text")).alias("head"))
        heads = _stored(heads.unionByName(head.select("file", F.col("head.line_no").alias("head_no"), F.col("head.text").alias("head"))), "report-heads")
    else:
        unclosed = None
        records = lines.where(kept).select("file", "line_no", value.alias("text"))
    names = _fields(F.regexp_replace(_trimmed(F.col("head")), r"\A\x{FEFF}", ""))
    heads = heads.select("file", "head_no", names.alias("names"))
    # What is the same for all records of a file is found once per file.
    places = [F.array_position("names", c).cast("int").alias(f"place_{i}") for i, c in enumerate(columns or ())]
    own = [c.alias(k) for k, c in (of_file or {}).items()]
    heads = heads.select("*", F.size("names").alias("n_names"), (F.size(F.array_distinct("names")) != F.size("names")).alias("twice"), *places, *own)

    rows = _lookup(records, heads, ["file"], "inner").where("line_no > head_no").withColumn("text", _trimmed(F.col("text")))
    # generated, so that a record is cut once: filters and columns above it share the fields
    rows = rows.select("*", F.inline(F.array(F.struct(_fields(F.col("text")).alias("fields")))).alias("fields"))
    error = (F.when(F.size("fields") != F.col("n_names"), F.format_string("ragged row at line %d of %s", "line_no", "file"))
             .when(F.col("text").contains("\r") & F.exists(F.split(F.regexp_replace("text", _QUOTED, ""), "\t"), lambda x: x.contains("\r")),
                   F.format_string("bare carriage return at line %d of %s", "line_no", "file"))
             .when(F.col("twice"), F.format_string("a column named twice in the header of %s", "file")))
    if columns is None:
        row = F.when(error.isNull(), F.map_from_arrays("names", F.transform("fields", lambda x: F.nullif(x, F.lit("")))))
    else:
        value = [F.get("fields", F.col(f"place_{i}") - 1) for i in range(len(columns))]
        row = F.struct(*[F.when(v != "", v).alias(c) for v, c in zip(value, columns, strict=True)])
    rows = rows.select("file", "line_no", row.alias("row"), error.alias("error"), F.when(error.isNotNull(), F.col("text")).alias("line"), *(of_file or {}))
    if unclosed is not None:
        lost = unclosed.select("file", "line_no", F.lit(None).cast(rows.schema["row"].dataType).alias("row"),
                               F.format_string("a quote opened at line %d of %s is never closed", "line_no", "file").alias("error"), F.lit(None).cast("string").alias("line"), *own)
        rows = rows.unionByName(lost)
    if mode == "quarantine":
        return rows
    return fail_if(rows, F.col("error").isNotNull(), F.col("error")).select("file", "line_no", "row", *(of_file or {}))
