"""What parsers do with bad rows (fail or quarantine), in one shape.

Every parser takes ``mode``: ``fail`` ends the job at the first bad row, as the
archive tool does; ``quarantine`` goes on without it (or with what the tool puts in
its place) and the parser's ``*_rejects`` returns the bad rows, whatever the source,
as ``source`` (file or document), ``line_no`` (null where a row is no line), ``line``
(the text as it was read) and ``reason``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fail_if

MODES = ("fail", "quarantine")


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return mode


def checked(df: DataFrame, reason: Column, mode: str) -> DataFrame:
    """``df`` as it is, or failing at the first row with a reason."""
    return fail_if(df, reason.isNotNull(), reason) if check_mode(mode) == "fail" else df


def reject_rows(df: DataFrame, reason: Column, source: Column, line: Column, line_no: Column | None = None) -> DataFrame:
    """The rows of ``df`` that have a reason, in the shape of all rejects."""
    number = F.lit(None) if line_no is None else line_no
    return df.select(source.cast("string").alias("source"), number.cast("long").alias("line_no"), line.cast("string").alias("line"),
                     reason.alias("reason")).where("reason is not null")
