"""The corpus pipeline: five stages over ``documents``, each written as Parquet
and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, hilbert, mixing, simhash, toxicity
from tidemark.llm.common import read
from tidemark.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores below one half stay."""
    allowed = F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels"), allowed))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays, that with the smallest id."""
    return simhash.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark stay."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target share asks for."""
    return mixing.mix(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and place, in runs of the Hilbert curve."""
    return hilbert.shard_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("decontamination", drop_leaks),
          ("mixing", mix_sources), ("sharding", cut_shards)]

# A classifier, fingerprints and alignments cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared
    folder and read again, so a lost executor costs no earlier stage."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline/{uuid.uuid4().hex}/{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
