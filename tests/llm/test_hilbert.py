"""Hilbert sharding: the curve, the cells, the cuts."""

import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import hilbert, queries

from .conftest import SMALL


@pytest.mark.parametrize("n, bits", [(1, 3), (2, 3), (3, 2), (3, 3), (4, 2), (2, 1)])
def test_curve_visits_every_cell_by_single_steps(spark, n, bits):
    cells = spark.range(1 << n * bits).select(
        *[F.shiftright("id", bits * j).bitwiseAND(F.lit((1 << bits) - 1)).alias(f"x{j}") for j in range(n)])
    rows = cells.withColumn("h", hilbert.hilbert_index([F.col(f"x{j}") for j in range(n)], bits)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(1 << n * bits))
    assert all(sum(abs(p[f"x{j}"] - q[f"x{j}"]) for j in range(n)) == 1 for p, q in zip(rows, rows[1:]))


def law(rows, shards=8):
    """Sizes near equal: off by no more than two halves of the longest row; slots gapless."""
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in range(shards):
        own = [r for r in rows if r["shard"] == s]
        assert abs(sum(r["size"] for r in own) - total / shards) <= most
        assert sorted(r["slot"] for r in own) == list(range(len(own)))


def test_query(spark, con):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.QUERIES["op8_hilbert_shards"](spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        text = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "bytes", None)
    law(got)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(queries.ORACLE["op8_hilbert_shards"]).fetchall()))
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [(r["hilbert"], r["doc_id"]) for r in order] == sorted((r["hilbert"], r["doc_id"]) for r in got)


def test_cells_are_ranks(spark):
    rows = spark.createDataFrame([(v,) for v in [3, 3, 3, 3, 1, 9, 9, None]], "d long")
    cell = hilbert._cell(rows, "d", 8, 3)
    assert [r[0] for r in rows.select(cell).collect()] == [1, 1, 1, 1, 0, 5, 5, 7]
    words = spark.createDataFrame([("b",), ("a",), (None,), ("",)], "d string")
    assert [r[0] for r in words.select(hilbert._cell(words, "d", 4, 2)).collect()] == [2, 1, 3, 0]


def test_runs_prune_on_every_dimension(spark):
    """A file filter on any one dimension skips shards; a random cut would skip none."""
    docs = spark.range(4096).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), (F.col("id") % 16).cast("string").alias("lang"),
                                    F.floor(F.col("id") / 256).cast("string").alias("source"), (F.floor(F.col("id") / 16) % 16).alias("n_chars"))
    rows = hilbert.shard_documents(docs).collect()
    for dim in ("lang", "source", "n_chars"):
        spans = [(min(x), max(x)) for s in range(8) if (x := [r[dim] for r in rows if r["shard"] == s])]
        values = sorted({r[dim] for r in rows})
        assert sum(a <= v <= b for a, b in spans for v in values) <= 0.6 * len(spans) * len(values)


def test_odd_rows(spark, odd_docs, no_docs):
    got = hilbert.shard_table(odd_docs.withColumns({"size": F.lit(1), "ID": F.lit(2), "pos": F.lit(3), "piece": F.lit(4)})).collect()
    assert len(got) == 11 and {r["size"] for r in got if r["id"] in (3, 4)} == {1}
    law(got)
    clash = odd_docs.withColumns({"shard": F.lit("mine"), "Slot": F.lit("mine")})
    kept = hilbert.shard_documents(clash)
    assert kept.columns == [*clash.columns, "hilbert", "shard_", "slot_"] and {r["shard"] for r in kept.collect()} == {"mine"}
    assert hilbert.shard_table(no_docs).collect() == [] and hilbert.shard_documents(no_docs).collect() == []
    same = spark.createDataFrame([(1, "x", "en", "a", 1)] * 40, odd_docs.schema)
    law(hilbert.shard_table(same).collect())
