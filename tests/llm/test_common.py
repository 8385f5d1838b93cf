"""Shared helpers: global order, look-ups beyond their broadcast bound, columns by exact name."""

import random

from pyspark.sql import functions as F

from tidemark.llm import mixing, warc
from tidemark.llm.common import lookup, numbered, ordered, pick


def test_ordered_totals(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "c" * 3]), rng.randint(0, 5), rng.randint(1, 9), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "s string, k long, n long, id long").repartition(7)
    got = ordered(df, ["s", "k", "id"], {"upto": "n"}, "test").orderBy("pos").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1], r[3]))
    assert [(r["s"], r["k"], r["n"], r["id"]) for r in got] == want
    assert [r["pos"] for r in got] == list(range(3000))
    total = 0
    for r in got:
        assert r["upto"] == total
        total += r["n"]
    assert ordered(df.limit(0), ["s"], {"upto": "n"}, "test").collect() == []


def test_lookup_beyond_the_bound_gives_the_same_rows(spark):
    big = spark.range(1000).select((F.col("id") % 10).alias("k"), "id")
    small = spark.range(8).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    near, far = lookup(big, small, ["k"]), lookup(big, small, ["k"], limit=3)
    assert sorted(map(str, near.collect())) == sorted(map(str, far.collect()))


def test_operators_beyond_the_bound(spark, monkeypatch, tmp_path):
    """With no broadcast allowed by count, mixing and WARC give the rows they give otherwise."""
    docs = spark.createDataFrame([(i, "w " * (i % 7), None if i % 5 == 0 else f"s{i % 5}") for i in range(200)], "doc_id long, text string, source string")
    pages = spark.createDataFrame([(i, "u", f"p{i % 9}") for i in range(60)], "page_id long, url string, html string")
    index = lambda p: sorted(map(str, warc.index_archive(spark, p).select("page_id", "record_type", "refers_to").collect()))
    plan = sorted(map(str, mixing.plan_table(docs).collect()))
    warc.write_archive(pages, str(tmp_path / "a"))
    for module in (mixing, warc):
        monkeypatch.setattr(module, "lookup", lambda big, small, on, how="left": lookup(big, small, on, how, limit=0))
    assert sorted(map(str, mixing.plan_table(docs).collect())) == plan
    warc.write_archive(pages, str(tmp_path / "b"))
    assert index(str(tmp_path / "a")) == index(str(tmp_path / "b"))


def test_columns_by_exact_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("id", "ID", "id")
    assert pick(df, "id").collect()[0][0] == 1 and pick(df, "ID").collect()[0][0] == 2
    assert numbered(df).toDF(*df.columns).columns == ["id", "ID", "id"]
