"""Toxicity by a linear classifier over character n-grams.

A text's features are the character n-grams that occur in it (lower-cased,
white space folded, a space at both ends), hashed to ``2 ** HASH_BITS``
slots and counted once.  Each slot has the naive Bayes log-count ratio

    r = log((p + 1) / (P + 2)) - log((q + 1) / (Q + 2))

of the p among P positive and q among Q negative training rows that have it.
Slots of at least ``MIN_POSITIVE`` positive rows and a ratio of ``MIN_RATIO`` or
more, and of half that ratio among the first ``SCREEN_ROWS`` of each mark, speak for the mark; the others, among them all that single texts are
remembered by, are left out.  A logistic regression is fitted on the features
scaled by r; a slot's final weight is r times its coefficient, so a text's score is
a sum of weights.

The model is fitted on a bounded sample of the labelled rows
(``MAX_POSITIVE`` and ``MAX_NEGATIVE``, those with the smallest hashes of
their id); the sample's negatives are re-weighted to the share that all
training rows have.  Scoring covers every row and the whole of its text.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, numbered, pick, stored

ORDERS = (5, 7, 9)
HASH_BITS = 20
MAX_POSITIVE, MAX_NEGATIVE = 10_000, 20_000
MIN_POSITIVE, MIN_RATIO = 4, 1.0
# Rows of each mark on which slots are screened first, by half the ratio: most n-grams of a text are in all texts.
SCREEN_ROWS = 2_000
EPOCHS, BATCH, RATE, L2 = 10, 64, 0.3, 1e-4
# Bytes of the sample's features that stay in memory; beyond that they are an unnamed file of their task, like Spark's own spills.
SPOOL_BYTES = 64 << 20
_SPACE = re.compile(r"\s+")


def features(text: str | None) -> np.ndarray:
    """Distinct slots of a text's character n-grams; null counts as empty."""
    flat = f" {_SPACE.sub(' ', (text or '').lower()).strip()} "
    c = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    h = c * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n - 1:] * np.uint32(0x9E3779B1)
        if n in ORDERS:
            out.append((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - HASH_BITS))
    if not out:
        return np.empty(0, np.int32)
    slots = np.concatenate(out).astype(np.int32)
    # The last of equal slots stays: linear, where a sort would not be.
    if not _LAST:
        _LAST.append(np.zeros(1 << HASH_BITS, np.int32))
    number = np.arange(len(slots), dtype=np.int32)
    _LAST[0][slots] = number
    return slots[_LAST[0][slots] == number]


_LAST: list[np.ndarray] = []  # scratch of one worker


def ratios(rows: Iterator[tuple[np.ndarray, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(kept slots, their log-count ratios) of rows (slots, label, weight)."""
    size = 1 << HASH_BITS
    p, q, seen, total = np.zeros(size), np.zeros(size), np.zeros(size, np.int32), [0.0, 0.0]
    for slots, label, weight in rows:
        (p if label else q)[slots] += weight
        total[0 if label else 1] += weight
        if label:
            seen[slots] += 1
    kept = np.flatnonzero(seen >= MIN_POSITIVE)
    r = np.log((p[kept] + 1) / (total[0] + 2)) - np.log((q[kept] + 1) / (total[1] + 2))
    return kept[r >= MIN_RATIO], r[r >= MIN_RATIO]


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, kept: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Slot weights (float32) and intercept from feature rows that are places in ``kept``,
    0/1 labels and row weights."""
    out = np.zeros(1 << HASH_BITS, np.float32)
    total = float(np.average(y, weights=weight)) if len(rows) else 0.5
    bias = float(np.clip(np.log(max(total, 1e-6) / max(1 - total, 1e-6)), -6, 6))
    if not len(kept) or not y.any() or y.all():  # nothing to tell apart: the share of positives, or 1/2
        return out, bias
    # Logistic regression by batches, step sizes by slot; rows in a fixed random order.
    rng, theta, grad2, bias2 = np.random.default_rng(7), np.zeros(len(kept)), np.full(len(kept), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            part = order[k:k + BATCH]
            idx = np.concatenate([rows[i] for i in part])
            own = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            z = np.bincount(own, theta[idx] * ratio[idx], len(part)) + bias
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part] / len(part)
            here, at = np.unique(idx, return_inverse=True)
            step = np.bincount(at, g[own], len(here)) * ratio[here] + L2 * theta[here]
            grad2[here] += step * step
            theta[here] -= RATE * step / np.sqrt(grad2[here])
            bias2 += g.sum() ** 2
            bias -= RATE * g.sum() / np.sqrt(bias2)
    out[kept] = theta * ratio
    return out, float(bias)


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> tuple[np.ndarray, float]:
    """Fit on the rows of ``docs`` that ``labels`` marks 0 or 1 and ``allowed`` (an
    expression over the column ``id``) admits.

    Rows with a null id or label are not used; an id that occurs in ``labels`` with
    both marks, or twice, counts once, as 1 if any mark is 1.  Of repeated ids in ``docs``
    one row is learnt from, that with the smallest hash of its text.  The fit runs in one
    task over the bounded sample and returns the model, of a fixed size.
    """
    spark = docs.sparkSession
    marks = pick(labels, id_col, label_col).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    marks = marks.where("id is not null and y in (0, 1)")
    if allowed is not None:
        marks = marks.where(allowed)
    marks = marks.groupBy("id").agg(F.max("y").cast("int").alias("y"))
    count = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    caps = {0: max_negative, 1: max_positive}
    # At most caps[0] + caps[1] ids: small enough to broadcast by construction.
    chosen = [marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in caps.items()]
    weights = F.when(F.col("y") == 1, 1.0).otherwise(
        (count.get(0, 0) / max(1, min(caps[0], count.get(0, 0)))) / (max(count.get(1, 0), 1) / max(1, min(caps[1], count.get(1, 0)))))
    chosen = stored(chosen[0].unionByName(chosen[1]).withColumn("w", weights), "toxicity-ids")

    def featurise(wanted=None):
        """Features of the sample's texts, or those among the slots that a broadcast bit set holds."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some = None if wanted is None else np.unpackbits(np.frombuffer(wanted.value, np.uint8)).astype(bool)
            least = {}  # smallest hash so far of each id: of a repeated id only ever smaller ones go on
            for b in batches:
                rows = []
                for i, (key, tie) in enumerate(zip(b.column("id").to_pylist(), b.column("tie").to_pylist())):
                    if key not in least or tie < least[key]:
                        least[key] = tie
                        rows.append(i)
                b = b.take(pa.array(rows, pa.int64()))
                x = [f if some is None else f[some[f]] for f in (features(t.as_py()) for t in b.column("text"))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "tie", "y", "w")), pa.array([f.tobytes() for f in x], pa.binary())],
                                                 names=["id", "tie", "y", "w", "x"])
        return run

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The slots that may be kept, as a bit set (a repeated id may count twice here: the fit counts it once)."""
        seen, rows = np.zeros((2, 1 << HASH_BITS), np.int32), [0, 0]
        for b in batches:
            for label, x in zip(b.column("y").to_pylist(), b.column("x")):
                seen[label][np.frombuffer(x.as_buffer(), np.int32)] += 1
                rows[label] += 1
        (q, p), (n_q, n_p) = seen, rows
        may = (p >= MIN_POSITIVE) & (np.log((p + 1) / (n_p + 2)) - np.log((q + 1) / (n_q + 2)) >= MIN_RATIO / 2)
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(may).tobytes()])], names=["bits"])

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two passes over the sample's features: their ratios, then the few slots that are kept."""
        y, w, sizes, last = [], [], [], None
        with tempfile.SpooledTemporaryFile(SPOOL_BYTES) as file:
            for b in batches:
                for key, label, weight, x in zip(*(b.column(c) for c in ("id", "y", "w", "x"))):
                    if key.as_py() == last:  # the same id again, with a larger hash
                        continue
                    last = key.as_py()
                    data = x.as_py()
                    file.write(data)
                    y.append(label.as_py())
                    w.append(weight.as_py())
                    sizes.append(len(data))

            def again() -> Iterator[np.ndarray]:
                file.seek(0)
                for n in sizes:
                    yield np.frombuffer(file.read(n), np.int32)

            kept, ratio = ratios(zip(again(), y, w))
            place = np.full(1 << HASH_BITS, -1, np.int32)
            place[kept] = np.arange(len(kept))
            rows = [(at := place[x])[at >= 0] for x in again()]
        theta, bias = fit(rows, np.array(y, float), np.array(w, float), kept, ratio)
        yield pa.RecordBatch.from_arrays([pa.array([theta.tobytes()]), pa.array([bias])], names=["theta", "bias"])

    bounded_batches(spark)
    texts = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").withColumn("tie", F.xxhash64("text"))
    kind = sample.schema["id"].dataType.simpleString()
    schema = f"id {kind}, tie long, y int, w double, x binary"
    # A first part of the sample says which slots need not travel.
    order = F.xxhash64("id")
    last = {y: chosen.where(F.col("y") == y).orderBy(order).limit(SCREEN_ROWS).agg(F.max(order)).first()[0] for y in caps}
    first = sample.where(order <= F.when(F.col("y") == 1, F.lit(last[1])).otherwise(F.lit(last[0])))
    bits = first.mapInArrow(featurise(), schema).select("y", "x").repartition(1).mapInArrow(screen, "bits binary").first()
    if bits is None:  # no row
        bits = {"bits": bytes(1 << (HASH_BITS - 3))}
    wanted = spark.sparkContext.broadcast(bytes(bits["bits"]))
    sample = sample.mapInArrow(featurise(wanted), schema)
    sample = sample.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "tie").select("id", "y", "w", "x")
    model = sample.mapInArrow(fit_all, "theta binary, bias double").first()
    if model is None:  # no partition had rows
        return fit([], np.empty(0), np.empty(0), np.empty(0, np.int64), np.empty(0))
    return np.frombuffer(bytes(model["theta"]), np.float32), model["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row: the modelled probability that the text is
    toxic.  Null and empty texts get the score of no features."""
    handle, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta = handle.value
        for b in batches:
            z = np.array([theta[features(t.as_py())].sum(dtype=np.float64) for t in b.column(1)]) + bias
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["id", "score"])

    bounded_batches(docs.sparkSession)
    part = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return part.mapInArrow(run, f"id {part.schema['id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` (all columns) that score below ``threshold``; the decision is
    taken row by row next to the text, so nothing is shuffled."""
    handle, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]
    at = docs.columns.index(text_col)
    rows = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta = handle.value
        for b in batches:
            z = np.array([theta[features(t.as_py())].sum(dtype=np.float64) for t in b.column(at)]) + bias
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))) < threshold))

    bounded_batches(docs.sparkSession)

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
