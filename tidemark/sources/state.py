"""JSON state files: S9 chunk state, S10 progress snapshot.

Both are parsed with ``from_json`` (permissive: an unreadable or invalid
document yields null, which counts as empty state), then exploded to long
form so later joins are plain equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PROGRESS_MAP
from .rejects import checked, reject_rows

_STATE = "struct<downloaded_chunks: array<bigint>>"


def _state_ids(json_col: str) -> tuple[Column, Column]:
    """(the ids of a state document, null if it is void; why it is void)."""
    ids = F.from_json(F.col(json_col), _STATE, {"mode": "PERMISSIVE"})["downloaded_chunks"]
    # a null element means a value that was not an integer
    bad = F.exists(ids, lambda x: x.isNull() | (x < 0))
    reason = F.when(ids.isNull(), F.lit("no list of downloaded chunks")).when(bad, F.lit("a chunk id that is no count"))
    return F.when(reason.isNull(), F.array_distinct(ids)), reason


def parse_chunk_state(df: DataFrame, json_col: str = "state_json", file_id: str = "file_id", mode: str = "quarantine") -> DataFrame:
    """(file_id, chunk_id) for every distinct finished chunk id.

    Invalid JSON, a missing ``downloaded_chunks`` field or any id that is not
    a non-negative integer makes the whole state empty, as the tool does
    (:func:`state_rejects` has these documents); ``mode='fail'`` fails on them."""
    clean, reason = _state_ids(json_col)
    return checked(df, reason, mode).select(F.col(file_id).alias("file_id"), F.explode(clean).alias("chunk_id"))


def state_rejects(df: DataFrame, json_col: str = "state_json", file_id: str = "file_id") -> DataFrame:
    """The void state documents as (source, line_no, line, reason)."""
    return reject_rows(df, _state_ids(json_col)[1], F.col(file_id), F.col(json_col))


def read_chunk_state(spark: SparkSession, path_glob: str) -> DataFrame:
    """S9 source: ``*.meta.json`` files -> (file_id, chunk_id).  The file id is
    the data file name the state belongs to (``X.meta.json`` -> ``X``)."""
    raw = spark.read.text(path_glob, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.meta\.json$", "").alias("file_id"),
        F.col("value").alias("state_json"))
    return parse_chunk_state(raw)


def _progress(json_col: str) -> tuple[Column, Column]:
    m = F.from_json(F.col(json_col), PROGRESS_MAP, {"mode": "PERMISSIVE"})
    empty = F.regexp_replace(F.col(json_col), r"\s", "") == "{}"
    bad = F.exists(F.map_values(m), lambda p: p.isNull())
    return m, F.when(m.isNull() | ((F.size(m) == 0) & ~empty), F.lit("no object of runs")).when(bad, F.lit("a run without progress"))


def progress_rejects(df: DataFrame, json_col: str = "json", source: str | None = None) -> DataFrame:
    """Snapshots that are no object of runs, as (source, line_no, line, reason)."""
    return reject_rows(df, _progress(json_col)[1], F.col(source) if source else F.lit(None), F.col(json_col))


def parse_progress(df: DataFrame, json_col: str = "json", mode: str = "quarantine") -> DataFrame:
    """A JSON object keyed by run -> one row per run with the stage
    structs flattened (percentages as double).  An unreadable document counts as
    empty (:func:`progress_rejects` has it); ``mode='fail'`` fails on it."""
    m, reason = _progress(json_col)
    e = checked(df, reason, mode).select(F.explode(m).alias("run_key", "p"))
    return e.select(
        "run_key", "p.run_id", "p.stage", "p.overall_percent",
        *[F.col(f"p.{s}.{f}").alias(f"{s}_{f}") for s in ("download", "extraction", "compression")
          for f in ("bytes_done", "bytes_total", "weight", "percent")])


def read_progress(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """S10 source: progress snapshot files -- one (possibly pretty-printed)
    JSON object per file by default, or JSON lines of single-run objects as
    written by the export (``json_lines=True``, splittable)."""
    raw = spark.read.text(path, wholetext=not json_lines)
    raw = raw.select(F.col("value").alias("json")).where(F.trim("json") != "")
    return parse_progress(raw)
