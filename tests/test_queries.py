"""Every registered query against its DuckDB oracle on the sf0.001 tables
(row count, columns and an order-insensitive value multiset), plus the entry
contract.  The full sf0.01 check is ``scripts/check_oracle.py``."""

import math
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.fixtures import TABLES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    c.execute("SET TimeZone='UTC'")
    return c


def test_entry_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "run_accession" in df.columns
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80


@pytest.mark.parametrize("name", sorted(q for q in entry.oracle_sql() if not q.startswith("op") and q != "pipeline"))
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    srows = Counter(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = {c: i for i, c in enumerate(dcols)}
    drows = Counter(tuple(_norm(r[idx[c]]) for c in cols) for r in res.fetchall())
    assert srows == drows


ORDERED = ["sliding_speed", "instant_speed", "global_progress", "stage_transitions", "running_bytes",
           "chunk_retries", "backoff_cost", "volume_attempts", "failed_volume_manifest"]


@pytest.mark.parametrize("name", ORDERED)
def test_ordered_query_split_path_matches_oracle(spark, con, name):
    spark.conf.set("spark.tidemark.scan.split", "always")
    try:
        test_query_matches_oracle(spark, con, name)
    finally:
        spark.conf.unset("spark.tidemark.scan.split")
