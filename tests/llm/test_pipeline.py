"""The pipeline, stage by stage, against what each stage's operator says of the rows it gets."""

from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from tidemark.llm import decontam, hilbert, mixing, queries, toxicity

from .conftest import SMALL
from .test_decontam import holds
from .test_simhash import classes, fingerprint


def test_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.ORACLE) <= set(queries.QUERIES) and "pipeline" not in entry.oracle_sql()


def test_stages(spark, tmp_path):
    docs = start = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        rows[name] = (before.collect(), docs.collect())
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == start.columns
    had, kept = rows["toxicity"]
    model = toxicity.train(start, spark.read.parquet(f"{SMALL}/labels.parquet"), F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    clean = {r["id"] for r in toxicity.score(start, model).where("score < 0.5").collect()}
    assert sorted(r["doc_id"] for r in kept) == sorted(clean) and len(kept) > 0.8 * len(had)
    had, kept = rows["simhash_near_dedup"]
    had = sorted(had, key=lambda r: r["doc_id"])
    roots = classes([fingerprint(r["text"]) for r in had])
    assert sorted(r["doc_id"] for r in kept) == sorted({had[c]["doc_id"] for c in roots})
    had, kept = rows["decontamination"]
    index = decontam.Index([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()])
    exact = {r["doc_id"] for r in had if any(r2["text"] in r["text"] for r2 in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect())}
    gone = {r["doc_id"] for r in had} - {r["doc_id"] for r in kept}
    assert exact <= gone and all(holds(index, r["text"]) for r in had if r["doc_id"] in gone)
    had, kept = rows["mixing"]
    plan = mixing.plan_table(spark.read.parquet(f"{tmp_path}/2")).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter({r["id"]: r["copies"] for r in plan if r["copies"]})
    had, kept = rows["sharding"]
    assert Counter(r["doc_id"] for r in had) == Counter(r["doc_id"] for r in kept)
    total = sum(len(r["text"].encode()) + 1 for r in kept)
    for s in range(hilbert.SHARDS):
        own = [r for r in kept if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(len(r["text"].encode()) + 1 for r in own) - total / 8) <= max(len(r["text"].encode()) + 1 for r in kept)


def test_run_equals_stages(spark):
    got = pipeline.run(spark, SMALL)
    assert {"doc_id", "text", "shard", "slot"} <= set(got.columns) and got.count() > 0
    assert got.groupBy("shard", "slot").count().where("count > 1").isEmpty()


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):
    extra = odd_docs.withColumns({"ID": F.lit(1), "fp": F.lit(2), "size": F.lit(3), "Shard": F.lit(4), "mix_u": F.lit(0.5)}).select("*", F.lit("x").alias("DOC_ID"))
    for docs in (odd_docs, extra, no_docs):
        for i, (name, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, docs, SMALL)
            rows = out.collect()
            assert i == len(pipeline.STAGES) - 1 or out.columns == docs.columns, name
            want = {"toxicity": 11, "simhash_near_dedup": 4, "decontamination": 11, "mixing": len(rows), "sharding": 11}[name]
            assert len(rows) == (want if docs is not no_docs else 0), name
