"""Exact top-k search by tiled matrix products.

Query vectors and candidate vectors are packed into blocks: one row holds up
to ``QUERY_ROWS`` queries or ``SHARD_ROWS`` candidates as a matrix.  Every
query block meets every shard (a stated query set against all rows, block by
block); each meeting is one tile, a matrix product that keeps only the tile's
``k`` best per query.  A task merges the lists of its own tiles as it goes; the
tasks' lists are then merged as a tree, ``FAN`` lists at a time, so no task sees
more than about ``FAN`` lists of one query block.

Queries and shards meet by a shuffle, however small the stored queries look: a
copy of them goes to every deal of shards, which their file size does not show,
so a broadcast chosen by that size would bring all copies to the driver at once.

Vectors of different lengths never meet.  Scores are exact: products run in
floating point only while every partial sum is below 2^53, in 64-bit integers
below 2^63, and in Python integers beyond (then cut to the range of a long).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pick, stored

QUERY_ROWS, SHARD_ROWS, FAN = 1024, 2048, 8
# Bytes of query blocks, with their lists, that one task holds against its shards.
ASK_BYTES = 128 << 20
_BLOCK = "dim int, ids binary, vecs binary"
_LISTS = "q long, node long, n int, scores binary, ids binary"


def floor_scaled(factor: float = 256.0) -> Callable[[Column], Column]:
    """A quantiser: floor(factor * x), x taken as double; doubles of 2^53 and more are whole already."""
    def quantise(x: Column) -> Column:
        scaled = x.cast("double") * factor
        return F.when(F.abs(scaled) < float(1 << 53), F.floor(scaled).cast("double")).otherwise(scaled)
    return quantise


def _pack(rows: int):
    """Pack (id, dim, vec) rows into blocks of one length each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, list] = {}

        def close(dim: int) -> pa.RecordBatch:
            ids, vecs = (np.concatenate(x) for x in zip(*open_blocks.pop(dim)))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([vecs.tobytes()])],
                                              names=["dim", "ids", "vecs"])

        for b in batches:
            ids, dims = b.column("id").to_numpy(), b.column("dim").to_numpy()
            lists = b.column("vec")
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
            for dim in np.unique(dims).tolist():
                which = np.flatnonzero(dims == dim)
                take = flat[(at[which][:, None] + np.arange(dim)).ravel()].reshape(len(which), dim)
                while len(which):
                    held = open_blocks.setdefault(dim, [])
                    room = rows - sum(len(i) for i, _ in held)
                    held.append((ids[which[:room]], take[:room]))
                    which, take = which[room:], take[room:]
                    if sum(len(i) for i, _ in held) >= rows:
                        yield close(dim)
        for dim in list(open_blocks):
            yield close(dim)
    return run


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    bound = (np.abs(q).max(initial=0)) * (np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound < 2 ** 53:
        return (q @ c.T).astype(np.int64)
    if bound < 2 ** 63:
        return q.astype(np.int64) @ c.T.astype(np.int64)
    big = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return np.clip(big, -2 ** 63, 2 ** 63 - 1).astype(np.int64)


def _narrow(scores: np.ndarray, ids: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The admitted places of each row in its first columns, if that takes a quarter of the columns at most."""
    n = held.sum(axis=1)
    width = max(int(n.max(initial=0)), 1)
    if 4 * width > scores.shape[1]:
        return scores, ids, held
    r, c = np.nonzero(held)
    to = r, np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros((len(n), width), np.int64), np.zeros((len(n), width), np.int64), np.zeros((len(n), width), bool)
    out[0][to], out[1][to], out[2][to] = scores[r, c], np.broadcast_to(ids, scores.shape)[r, c], True
    return out


def _best(scores: np.ndarray, ids: np.ndarray, held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the ``k`` best of the places that ``held`` admits: highest score, then smallest id."""
    scores, ids, held = _narrow(scores, ids, held)
    if scores.shape[1] > k:
        # Partial selection: everything that ties with or beats the k-th score, then an exact sort of it.
        low = np.where(held, scores, np.iinfo(np.int64).min)
        low.partition(scores.shape[1] - k, axis=1)
        held = held & (scores >= low[:, scores.shape[1] - k, None])
        del low
        scores, ids, held = _narrow(scores, ids, held)
    ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, -scores.astype(object) if (scores == np.iinfo(np.int64).min).any() else -scores, ~held), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in (scores, ids, held))


def _merged(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _best(*(np.concatenate(x, axis=1) for x in zip(*lists)), k)


def _lists(scores: bytes, ids: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s = np.frombuffer(scores, np.int64).reshape(n, -1)
    both = np.frombuffer(ids, np.int64).reshape(n, 2 * s.shape[1])
    return s, both[:, :s.shape[1]], both[:, s.shape[1]:].astype(bool)


def _to_bytes(scores: np.ndarray, ids: np.ndarray, held: np.ndarray) -> tuple[bytes, bytes]:
    return scores.astype(np.int64).tobytes(), np.concatenate((ids.astype(np.int64), held.astype(np.int64)), axis=1).tobytes()


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          quantise=None) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` best rows for each query row.

    ``queries`` is an expression over the column ``id``.  ``quantise`` maps an
    element column to an integral double (``floor_scaled()`` if not given).  A query
    never meets rows with its own id.  Vectors that are null, or hold a null or
    non-finite element, and rows with a null id take no part; ties go to the
    smaller id.  Repeated rows are rows: each is a candidate, and a query id that
    occurs n times gets n lists.  Fewer than ``k`` candidates give shorter lists.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = pick(vectors, id_col, vec_col).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    unfit = F.exists("vec", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(~unfit)
    rows = rows.select("id", F.size("vec").alias("dim"), F.transform("vec", quantise or floor_scaled()).alias("vec"))
    shards = rows.mapInArrow(_pack(SHARD_ROWS), _BLOCK).withColumn("node", F.monotonically_increasing_id())
    shards = stored(shards, "topk-shards")
    # Query rows come together first, so that their blocks are full.
    asks = stored(rows.where(queries), "topk-asks")
    asks = asks.repartition(max(1, math.ceil(asks.count() / QUERY_ROWS / 4))).mapInArrow(_pack(QUERY_ROWS), _BLOCK)
    asks = stored(asks.withColumn("q", F.monotonically_increasing_id()), "topk-queries")
    n_shards = shards.count()
    held_bytes = asks.agg(F.sum(F.octet_length("ids").cast("long") * (F.col("dim") + 1 + 3 * k))).first()[0] or 0
    parts = max(1, math.ceil(held_bytes / ASK_BYTES))
    # A copy of each query block goes to every deal of shards, and one of each shard to every part of the
    # queries; the pairs of a deal and a part are the tiles of a cell.  A few deals for each core keep all of
    # them busy; more would only copy the queries more often.  All queries are one part while a task can hold them.
    deals = max(1, min(n_shards, 4 * spark.sparkContext.defaultParallelism))
    asked = asks.select("dim", "q", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"),
                        F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int").alias("part"),
                        F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    dealt = shards.select("*", F.pmod(F.xxhash64("node"), F.lit(deals)).cast("int").alias("deal"),
                          F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    pairs = (dealt.join(asked.hint("merge"), ["dim", "deal", "part"])
             .select("dim", "deal", "part", "q", "node", "q_ids", "q_vecs", "ids", "vecs"))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}  # held: by query block, a node for its list, and the list

        def close() -> Iterator[pa.RecordBatch]:
            for q, (node, best) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q]), pa.array([node]), pa.array([len(best[0])], pa.int32()), *(pa.array([x]) for x in _to_bytes(*best))],
                    names=["q", "node", "n", "scores", "ids"])
            held.clear()

        for b in batches:
            for i in range(b.num_rows):
                dim, deal, part, q, node, q_ids, q_vecs, ids, vecs = (c[i].as_py() for c in b.columns)
                if cell != (dim, deal, part):
                    yield from close()
                    cell = dim, deal, part
                q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                s = _product(np.frombuffer(q_vecs).reshape(len(q_ids), dim), np.frombuffer(vecs).reshape(len(ids), dim))
                fit = q_ids[:, None] != ids[None, :]
                if q in held:
                    node, before = held[q]
                    if before[0].shape[1] == k:
                        # What a full list's last score beats can't come into the list.
                        fit &= s >= np.where(before[2][:, -1], before[0][:, -1], np.iinfo(np.int64).min)[:, None]
                    held[q] = node, _merged([before, _best(s, ids[None, :], fit, k)], k)
                else:
                    held[q] = node, _best(s, ids[None, :], fit, k)
        yield from close()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        n = group["n"].iloc[0]
        best = _merged([_lists(*r, n) for r in zip(group["scores"], group["ids"])], k)
        scores, ids = _to_bytes(*best)
        return pd.DataFrame({"q": group["q"].iloc[:1], "node": group["node"].iloc[:1], "n": group["n"].iloc[:1],
                             "scores": [scores], "ids": [ids]})

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q_ids, n, scores, ids = (b.column(c)[i].as_py() for c in ("q_ids", "n", "scores", "ids"))
                s, who, held = _lists(scores, ids, n)
                r, c = np.nonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(q_ids, np.int64)[r]), pa.array(c.astype(np.int32) + 1),
                                                  pa.array(who[r, c]), pa.array(s[r, c])], names=["query_id", "rank", "id", "score"])

    lists = pairs.mapInArrow(tile, _LISTS)
    for level in range(math.ceil(math.log(deals, FAN)), 0, -1):
        # About FAN lists of a query block meet in each of FAN ** (level - 1) nodes.
        lists = (lists.withColumn("node", F.pmod(F.xxhash64("node", F.lit(level)), F.lit(FAN ** (level - 1))))
                 .groupBy("q", "node").applyInPandas(merge, _LISTS))
    return (lists.join(asks.select("q", F.col("ids").alias("q_ids")).hint("merge"), "q")
            .mapInArrow(unroll, "query_id long, rank int, id long, score long"))
