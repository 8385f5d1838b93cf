"""SimHash near-duplicates by pivot distance tables.

A document's fingerprint has one bit for each majority among the XXH64 hashes
of its word shingles.  Documents whose fingerprints differ in at most
``max_bits`` bits are linked; a class is a connected component of links.

Finding the links rests on the triangle inequality: for any reference
fingerprint r, the Hamming distances of x and y to r differ by no more than x
and y do.  Two kinds of distance tables are used:

* *Staircase references* of a block of bits (its lowest t bits set, t = 0..w),
  measured over that block.  Neighbouring coordinates differ by one, up or
  down by the bit between them, so a block's coordinates fix the block.  With
  b blocks, a pair within ``max_bits`` differs in at most ``max_bits`` of
  them: some ``b - max_bits`` blocks have equal coordinates.  Those
  coordinates are the join key, so no pair within reach is lost.
* *Spread references* over all 64 bits.  Inside a bucket, sorted by the first
  coordinate, pairs are discarded whose largest coordinate difference exceeds
  ``max_bits``; the survivors are verified bit by bit.

Buckets with more than ``BUCKET`` fingerprints go on to finer blocks (4, then
8, then 16 blocks for two bits), where the key fixes 32, 48 and 56 of the 64
bits: the last level has at most 2^8 fingerprints in a bucket.  Work is on
distinct fingerprints; a bucket gives a star for each of its local components,
never its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, column_no, components, lookup, numbered, pick, stored

SHINGLE, MAX_BITS, SEED = 3, 2, 42
# Fingerprints of a bucket above which finer blocks take over.
BUCKET = 1024
# Spread references: the tables' coordinates inside a bucket.
SPREAD = [xxhash.xxh64_intdigest(f"reference {i}".encode(), SEED) for i in range(12)]
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of one text (UTF-8).  A-Z count as a-z; words are runs
    without ASCII white space; a text of fewer words than a shingle is one shingle;
    null or no words give 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(flat[a:b], seed) for a, b in zip(starts, ends[k - 1:].tolist())])
    n = len(raw) // 8
    at = np.frombuffer(raw, np.uint8).reshape(n, 8) + np.arange(0, 2048, 256, dtype=np.uint16)
    ones = np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * ones > n).ravel()).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 seed: int = SEED) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            fps = [fingerprint(texts[i].as_py(), shingle, seed) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"])

    bounded_batches(docs.sparkSession)
    part = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary"))
    kind = part.schema["id"].dataType.simpleString()
    return part.mapInArrow(run, f"id {kind}, fp long")


def _coordinates(fp: F.Column, first: int, width: int) -> F.Column:
    """Distances to a block's staircase references, over that block."""
    mask = ((1 << width) - 1) << first
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(signed(((1 << t) - 1) << first)).cast("long"))
                                 .bitwiseAND(F.lit(signed(mask)).cast("long"))).cast("byte") for t in range(width + 1)])


def _keyed(nodes: DataFrame, blocks: int, max_bits: int) -> DataFrame:
    """A row for each fingerprint and each way to keep ``blocks - max_bits`` blocks."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    table = nodes.select("fp", *[_coordinates(F.col("fp"), a, b - a).alias(f"d{i}")
                                 for i, (a, b) in enumerate(itertools.pairwise(cut))])
    keys = [F.xxhash64(F.lit(j), *[f"d{i}" for i in kept])
            for j, kept in enumerate(itertools.combinations(range(blocks), blocks - max_bits))]
    return table.select("fp", F.explode(F.array(*keys)).alias("key"))


def _stars(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one bucket, as a star (member, smallest member) for each local component."""
    refs = np.array(SPREAD, np.uint64)
    table = np.bitwise_count(fps[:, None] ^ refs).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    ends = np.searchsorted(table[:, 0], table[:, 0] + max_bits, side="right")
    root = np.arange(len(fps))
    links = []
    for i in range(len(fps) - 1):
        js = np.arange(i + 1, ends[i])
        js = js[(np.abs(table[js] - table[i]) <= max_bits).all(axis=1)]
        js = js[np.bitwise_count(fps[js] ^ fps[i]) <= max_bits]
        if len(js):
            links.append((np.full(len(js), i), js))
    if not links:
        return fps[:0], fps[:0]
    a, b = (np.concatenate(x) for x in zip(*links))
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    out = root != np.arange(len(fps))
    return fps[out], fps[root[out]]


def _verify(max_bits: int):
    """Over partitions sorted by key: the links of each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in itertools.chain(batches, [None]):
            if b is not None:
                rest_k = np.concatenate((rest_k, b.column("key").to_numpy(zero_copy_only=False)))
                rest_f = np.concatenate((rest_f, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(rest_k):
                continue
            edge = np.flatnonzero(np.diff(rest_k)) + 1
            starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(rest_k)]))
            if b is not None:  # the last bucket may go on in the next batch
                starts, ends = starts[:-1], ends[:-1]
            left, right = [], []
            size = ends - starts
            two = starts[size == 2]  # most buckets of any size are pairs: all at once
            x, y = rest_f[two], rest_f[two + 1]
            near = np.ones(len(two), bool)
            for r in SPREAD:
                near &= np.abs(np.bitwise_count(x ^ np.uint64(r)).astype(np.int8) - np.bitwise_count(y ^ np.uint64(r)).astype(np.int8)) <= max_bits
            near[near] = np.bitwise_count(x[near] ^ y[near]) <= max_bits
            left.append(x[near])
            right.append(y[near])
            for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
                p, q = _stars(rest_f[s:e], max_bits)
                left.append(p)
                right.append(q)
            done = ends[-1] if len(ends) else 0
            rest_k, rest_f = rest_k[done:], rest_f[done:]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (left, right)], names=["a", "b"])
    return run


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``nodes`` (distinct, column
    fp) within ``max_bits`` of each other, directly or through further links."""
    spark = nodes.sparkSession
    found, blocks = None, max_bits + 2
    while True:
        keyed = _keyed(nodes, blocks, max_bits)
        last = 64 * max_bits <= 8 * blocks or 2 * blocks > 64  # what a key leaves open is bounded
        hot = None
        if not last:
            hot = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("key"), "simhash-hot")
            if hot.isEmpty():
                last = True
            else:
                keyed, all_keyed = lookup(keyed, hot, ["key"], "left_anti"), keyed
        part = (keyed.repartition("key").sortWithinPartitions("key")
                .mapInArrow(_verify(max_bits), "a long, b long"))
        found = part if found is None else found.unionByName(part)
        if last:
            return found
        nodes = stored(lookup(all_keyed, hot, ["key"], "left_semi").select("fp").distinct(), "simhash-nodes")
        blocks *= 2


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
            max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component) for every row of ``docs``: ``component`` is the smallest
    id reachable over links of at most ``max_bits`` differing bits.

    Null and empty texts have fingerprint 0 and are linked like any other; rows
    with equal texts, or repeated rows, share a fingerprint; a null id gets a
    component but never names one, unless its whole class has null ids.
    """
    return _classes(docs, id_col, text_col, shingle, max_bits).select("id", "fp", "component")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    nodes = stored(fps.groupBy("fp").agg(F.min("id").alias("low")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), max_bits), "simhash-components")
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component")), "root").select("fp", "root", "component")
    return fps.join(named, "fp")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                     max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each class, that with the smallest id; all columns of ``docs`` kept.

    Of rows that share the smallest id of their class (repeated ids), and in
    classes without any id, the row with the smallest text stays; among wholly
    equal rows it does not matter which.
    """
    found = stored(_classes(docs, id_col, text_col, shingle, max_bits), "simhash-classes")
    key, text = column_no(docs, id_col), column_no(docs, text_col)
    rows = numbered(docs)
    # An id that occurs once is decided by itself; the few others, and null ids, row by row.
    ids = found.groupBy("id").agg(F.count("*").alias("n"), F.min("component").alias("low"))
    ids = stored(ids.where("n > 1 or id is null or id <> low").select(F.col("id").alias("odd"), "n"), "simhash-ids")
    plain = rows.where(F.col(key).isNotNull()).join(ids, F.col(key) == F.col("odd"), "left_anti")
    repeated = ids.where("n > 1 or odd is null")
    if repeated.isEmpty():
        return plain.toDF(*docs.columns)
    odd = rows.join(repeated, F.col(key).eqNullSafe(F.col("odd")), "left_semi")
    odd = stored(odd.withColumn("row_no", F.monotonically_increasing_id()), "simhash-odd")
    fps = fingerprints(odd, "row_no", text, shingle).select(F.col("id").alias("row_no"), "fp")
    named = found.groupBy("fp").agg(F.first("root").alias("root"), F.first("component").alias("component"))
    best = (odd.select("row_no", F.col(key).alias("own"), F.struct(F.coalesce(text, F.lit("")), "row_no").alias("rank"))
            .join(fps, "row_no").join(named, "fp").where(F.col("own").eqNullSafe(F.col("component")))
            .groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.row_no").alias("row_no")))
    kept = odd.join(best, "row_no", "left_semi").drop("row_no")
    return plain.unionByName(kept).toDF(*docs.columns)
