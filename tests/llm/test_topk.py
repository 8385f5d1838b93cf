"""Exact top-k against every pair, and against SQL."""

import math
import random

from pyspark.sql import functions as F

from tidemark.llm import queries, topk

from .conftest import SMALL


def brute(rows, wants, k=5, factor=256):
    fine = [(i, [math.floor(factor * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if wants(q):
            found = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in fine if i != q and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def run(df, k=5):
    return sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 50 == 0, k).collect())


def test_query_matches_sql(spark, con):
    got = queries.QUERIES["op3_exact_top_k"](spark, SMALL)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.ORACLE["op3_exact_top_k"]).fetchall())


def test_floor_of_tiny_and_huge_components(spark):
    odd = [-1e-20, 5e-324, -5e-324, 1e-310, -0.0, 0.0, -0.3, 0.3, -1 / 256, 1 / 256, -2.0 ** 45 - 0.5, 2.0 ** 45 + 0.25, 2.0 ** 60, -2.0 ** 60, 0.1 + 0.2]
    rng = random.Random(4)
    rows = [(i, [rng.choice(odd[:-5]) for _ in range(4)]) for i in range(150)] + [(150 + i, [x, 1 / 256, -1e-20, 0.0]) for i, x in enumerate(odd)]
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute(rows, lambda q: q % 50 == 0)


def test_ties_odd_vectors_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-1, 1)) / 4 for _ in range(3)]) for i in range(120)]  # many ties
    rows += [(200, None), (250, [1.0, None, 1.0]), (300, [float("nan"), 1.0, 1.0]), (350, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]),
             (400, [1.0, 2.0]), (401, [-1.5, 0.3]), (450, []), (77, [0.25, 0.25, 0.25]), (50, [0.25, 0.0, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert run(df.withColumns({"id": F.lit(1), "score": F.lit(2), "dim": F.lit(0)})) == brute(rows, lambda q: q % 50 == 0)
    assert run(df.limit(0)) == []


def test_many_tiles_merge_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "FAN", 3)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    single = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    assert run(df) == brute(single, lambda q: q % 50 == 0)


def test_large_components_stay_exact(spark):
    rows = [(0, [1e9, 3.0]), (1, [1e9, -7.0]), (2, [-1e9, 1.0]), (3, [1e17, 1.0]), (50, [1e17, 1e17])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert run(df) == brute(rows, lambda q: q % 50 == 0)


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert run(df) == [(0, 1, 1, 256 * 512)]
    assert run(df.where("vec_id = 0")) == []


def test_no_table_is_broadcast(spark):
    """The stored queries look small, but a copy of them goes to every deal of shards."""
    rows = [(i, [float(i % 7), 1.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.top_k(df, F.col("id") % 50 == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda q: q % 50 == 0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_tasks_merge_their_own_tiles(spark, monkeypatch):
    """A task gives one list for each query block of a cell, not one for each tile."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 2)
    given = []
    applied = type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema, *a, **b: given.append(applied(self, f, schema, *a, **b)) or given[-1])
    rows = [(i, [float(i % 11), 1.0]) for i in range(600)]
    topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 50 == 0)
    lists = next(x for x in given if "scores" in x.columns)
    cells = 4 * spark.sparkContext.defaultParallelism
    assert lists.groupBy("q").count().agg({"count": "max"}).first()[0] <= cells < 300


def test_queries_of_more_than_one_part(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 8)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    monkeypatch.setattr(topk, "FAN", 2)
    monkeypatch.setattr(topk, "ASK_BYTES", 1000)
    rng = random.Random(5)
    rows = [(rng.randrange(300), [float(rng.randint(-2, 2)) / 4 for _ in range(rng.choice([2, 3]))]) for _ in range(700)]  # repeats, ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert run(df) == brute(rows, lambda q: q % 50 == 0)
    assert run(df, 1) == brute(rows, lambda q: q % 50 == 0, 1)
