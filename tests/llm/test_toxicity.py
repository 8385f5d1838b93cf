"""Toxicity: held-out accuracy, odd rows, and the fold that is not learnt from."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    return toxicity.train(read("documents"), read("labels"), F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op2_toxicity"](spark, SF)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    # 30 toxic rows to learn from, one or two in some languages; the larger table below has the bar for each
    assert np.mean([a == b for a, b in held]) >= 0.9
    assert sum(a and b for a, b in held) >= 0.6 * sum(a for a, _ in held)


def test_held_out_recall_of_every_language(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    rows = queries.QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1").where("held_out").join(read("labels"), "doc_id")
    found = rows.join(read("documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(
        F.sum("toxic").alias("n"), F.sum(F.col("toxic") * F.col("predicted")).alias("hit"),
        F.sum((1 - F.col("toxic")) * F.col("predicted")).alias("wrong"), F.sum(1 - F.col("toxic")).alias("clean")).collect()
    assert len(found) == 4 and all(r["hit"] >= 0.8 * r["n"] > 0 for r in found)
    assert sum(r["wrong"] for r in found) <= 0.005 * sum(r["clean"] for r in found)


def test_refit_by_the_book(spark):
    """Ratios counted by hand, and a plain logistic regression that ranks as the fitted one does."""
    from collections import Counter
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in ("lorem", "dolor", "amet") for b in ("ipsu", "sita", "cons") for c in ("mas", "tur", "elit")]
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(words, 12))
        rows.append((i, text + (" grumblefish" if i % 4 == 0 else ""), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    x, p, q = {i: set(toxicity.features(t).tolist()) for i, t, _ in rows}, Counter(), Counter()
    for i, _, y in rows:
        (p if y else q).update(x[i])
    big_p, big_q = sum(y for *_, y in rows), sum(1 - y for *_, y in rows)
    ratio = {s: np.log((p[s] + 1) / (big_p + 2)) - np.log((q[s] + 1) / (big_q + 2)) for s in p if p[s] >= toxicity.MIN_POSITIVE}
    ratio = {s: r for s, r in ratio.items() if r >= toxicity.MIN_RATIO}
    theta, bias = toxicity.train(docs, labels)
    assert set(np.flatnonzero(theta).tolist()) <= set(ratio)
    kept, r = toxicity.ratios((toxicity.features(t), y, 1.0) for _, t, y in rows)
    assert dict(zip(kept.tolist(), r)) == pytest.approx(ratio)
    slots = sorted(ratio)
    m = np.array([[ratio[s] if s in x[i] else 0 for s in slots] for i, *_ in rows])
    y, w, b = np.array([y for *_, y in rows]), np.zeros(len(slots)), 0.0
    for _ in range(300):
        g = 1 / (1 + np.exp(-(m @ w + b))) - y
        w, b = w - 0.01 * (m.T @ g / len(y) * 10 + toxicity.L2 * w), b - 0.1 * g.mean()
    plain = (m @ w + b) >= 0
    ours = np.array([theta[list(x[i])].sum() + bias >= 0 for i, *_ in rows])
    assert (plain == ours).all() and (ours == (y == 1)).all()


def test_repeated_ids_count_once(spark):
    rows = [(i, "kind words of a quiet day " * 3 + f"number{i}") for i in range(40)] + [(100 + i, f"you utter grumblefish number{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows], "doc_id long, toxic int")
    copies = docs.unionByName(docs.where("doc_id = 100")).unionByName(docs.where("doc_id = 3").crossJoin(spark.range(500)).drop("id"))
    a, b = toxicity.train(docs, labels), toxicity.train(copies.repartition(9), labels)
    assert np.allclose(a[0], b[0]) and a[1] == pytest.approx(b[1]) and a[0].any()


def test_plain_cases(spark, model):
    texts = ["you idiot, what a pathetic loser", "IDIOT!! SCUM!! MORON!!", "the thing of that and those reading on", "", None, "a", "x" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert got[0] > 0.5 and got[1] > 0.5 and max(got[i] for i in (2, 3, 4, 5, 6)) < 0.5 and got[3] == got[4]
    assert sorted(r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()) == [2, 3, 4, 5, 6]


def test_odd_rows_and_tables(spark, odd_docs, no_docs, model):
    clash = odd_docs.withColumns({"score": F.lit(9.0), "ID": F.lit(1), "y": F.lit("y")})
    assert toxicity.score(clash, model).count() == 11
    assert toxicity.keep_clean(clash, model).columns == clash.columns
    assert toxicity.score(no_docs, model).collect() == [] and toxicity.keep_clean(no_docs, model).collect() == []
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 5)], "doc_id long, toxic int")
    for docs, marks in ((odd_docs, labels), (odd_docs, labels.limit(0)), (no_docs, labels)):
        theta, bias = toxicity.train(docs, marks)
        assert not theta.any() and np.isfinite(bias)  # one class or none: nothing to tell apart


def test_refit_is_the_same(spark, model):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    again = toxicity.train(read("documents").repartition(7), read("labels"), F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    assert np.allclose(again[0], model[0]) and again[1] == pytest.approx(model[1])


def test_features_are_distinct_and_whole():
    a, b = toxicity.features("abcabc  ABC\n"), toxicity.features("abcabc abc")
    assert sorted(a) == sorted(b) and len(set(a.tolist())) == len(a)
    assert len(toxicity.features("x" * 10_000 + " end")) < 30 and set(toxicity.features("the end")) - set(toxicity.features("the"))
