"""Quality: held-out accuracy, FTRL against its textbook form, odd rows, the fold that is not learnt from."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, queries

SF = "/root/testdata/sf0.01"


def allowed():
    return F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1


@pytest.fixture(scope="module")
def model(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    return quality.train(read("documents"), read("labels"), allowed())


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op11_quality"](spark, SF).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    bad, good = [p for y, p in held if y == 0], [p for y, p in held if y == 1]
    assert len(bad) > 10 and np.mean(bad) <= 0.05 and np.mean(good) >= 0.98


def test_updates_are_ftrl_proximal():
    """The same rows through the algorithm as published, on dictionaries."""
    rng, size = np.random.default_rng(5), 40
    state, z, n = (np.zeros(size + 1), np.zeros(size + 1)), {}, {}

    def w(i):
        if abs(z.get(i, 0)) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(200):
        slots = rng.choice(size, 6, replace=False).astype(np.int32)
        values, y = rng.random(6).astype(np.float32), int(slots.min() < 4)
        quality.learn(state, slots, values, y)
        x = {**{int(s): float(v) for s, v in zip(slots, values)}, size: 1.0}
        p = 1 / (1 + math.exp(-sum(w(i) * v for i, v in x.items())))
        for i, v, old in [(i, v, w(i)) for i, v in x.items()]:
            g = (p - y) * v
            sigma = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / quality.ALPHA
            z[i], n[i] = z.get(i, 0) + g - sigma * old, n.get(i, 0) + g * g
    assert np.allclose(quality.weights(*state), [w(i) if i in z else 0 for i in range(size + 1)])


def test_several_learners_and_any_partitioning_agree(spark, model, monkeypatch):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    again = quality.train(read("documents").repartition(7), read("labels"), allowed())
    assert np.allclose(again, model)
    monkeypatch.setattr(quality, "ROWS_PER_LEARNER", 60)
    several = quality.train(read("documents"), read("labels"), allowed())
    rows = read("documents").join(read("labels"), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    got = quality.score(rows, several).withColumnRenamed("id", "doc_id").join(read("labels"), "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == r["quality"] for r in got]) >= 0.95


def test_odd_rows_and_tables(spark, odd_docs, no_docs, model):
    clash = odd_docs.withColumns({"score": F.lit(9.0), "ID": F.lit(1), "y": F.lit("y"), "at": F.lit(0)})
    assert quality.score(clash, model).count() == 11
    assert quality.keep_good(clash, model).columns == clash.columns
    assert quality.score(no_docs, model).collect() == [] and quality.keep_good(no_docs, model).collect() == []
    by_id = {}
    for r in quality.score(odd_docs, model).collect():
        by_id.setdefault(r["id"], set()).add(r["score"])
    assert by_id[3] == by_id[4] == by_id[6]  # null, empty, white space: no features
    none = spark.createDataFrame([], "doc_id long, quality int")
    for docs, marks in ((odd_docs, none), (no_docs, none), (no_docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))):
        assert not quality.train(docs, marks).any()
    marks = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, 1), (2, 1), (3, 5), (4, None), (5, 0)], "doc_id long, quality int")
    repeated = odd_docs.unionByName(odd_docs).unionByName(odd_docs.withColumn("text", F.concat(F.lit("other "), "text")))
    w = quality.train(repeated, marks)
    assert np.isfinite(w).all() and w.any()
    assert np.allclose(w, quality.train(repeated.repartition(5), marks))


def test_features():
    slots, values = quality.features("One two, two!! ünï ONE")
    assert len(set(slots.tolist())) == len(slots) and values.dtype == np.float32
    assert np.isclose((values ** 2).sum(), 2)  # either stream has length 1
    for empty in (None, "", " \n\t"):
        assert len(quality.features(empty)[0]) == 0
    words = lambda t: quality.tokens(t)[0].tolist()
    assert words("a b") == words("A  b") and words("ab c") != words("a bc") and len(words("x,y##z9")) == 6
    assert len(quality.features("İstanbul " * 3)[0]) and len(quality.features("x" * 1_000_000 + " y")[0]) > 3
