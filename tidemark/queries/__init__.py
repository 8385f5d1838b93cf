"""Registered queries: one per operator of the inventory, each with a DuckDB
oracle where the semantics are SQL-expressible.

A query is ``fn(spark, sf_dir) -> DataFrame``; it reads the driver tables (or
views Spark derives from them) whole, applies the package operator and aliases
every output column to the oracle's name.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    from . import runs_q, listing_q, checksum_q, plan_q, progress_q, misc_q, stream_q  # noqa: F401
