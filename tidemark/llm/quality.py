"""Quality by logistic regression over hashed word n-grams, fitted with FTRL.

A text is read as two streams of tokens: its words (runs of letters and digits,
lower-cased) and marks (every other character that is not white space), and the
*forms* of those tokens: the kind of letters, a class of length, and whether the
token is new in the text, seen before, or equal to the one before it.  The
features are the n-grams of both streams (``WORD_ORDERS``, ``FORM_ORDERS``),
hashed to ``2 ** HASH_BITS`` slots; a feature's value is the square root of its
count, scaled so that either stream's values have length 1.

The model is a logistic regression with follow-the-regularised-leader updates
(FTRL-proximal: a sum of gradients ``z`` and of their squares ``n`` per slot, the
weights being a closed form of both with L1 and L2 terms).  Rows are dealt by a
hash of their id to learners; a learner goes over its rows ``EPOCHS`` times, in an
order fixed by their hashes, and the learners' states are averaged by their number
of rows.  A score is a sparse dot product.

Rows to learn from are at most ``MAX_ROWS`` of each mark, those with the smallest
hashes of their id; scoring covers every row and the whole of its text.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, numbered, pick, stored

HASH_BITS = 18
WORD_ORDERS, FORM_ORDERS = (1, 2), (1, 2, 3)
MAX_ROWS, ROWS_PER_LEARNER = 20_000, 5_000
# Bytes of a learner's features that stay in memory; beyond that they are an unnamed file of its task, like Spark's own spills.
SPOOL_BYTES = 64 << 20
EPOCHS, ALPHA, BETA, L1, L2 = 6, 1.0, 1.0, 0.02, 0.2
_P = np.uint32(0x01000193)
_TABLE: list[np.ndarray] = []  # kinds of the code points below 65536, made once per worker
SPACE, MARK, DIGIT, LOWER, UPPER = range(5)


def _kinds(c: np.ndarray) -> np.ndarray:
    """Kind of each code point; those beyond the first plane count as lower-case letters."""
    if not _TABLE:
        def kind(x: str) -> int:
            if x.isspace() or x < " ":
                return SPACE
            if not x.isalnum():
                return MARK
            return DIGIT if not x.isalpha() else UPPER if x.isupper() else LOWER
        _TABLE.append(np.array([kind(chr(i)) for i in range(1 << 16)], np.uint8))
    out = np.full(len(c), LOWER, np.uint8)
    low = c < (1 << 16)
    out[low] = _TABLE[0][c[low]]
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, hashes of their forms), one of each per token."""
    text = text or ""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds(c)
    low = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(low) != len(c):  # a letter whose lower case is longer: such texts keep their case
        low = c
    word = kind > MARK
    before = np.concatenate(([False], word[:-1])) if len(c) else word
    start = np.flatnonzero((kind == MARK) | (word & ~before))
    if not len(start):
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    held = np.flatnonzero(kind != SPACE)
    first = np.searchsorted(held, start)  # where each token starts among the characters that are not space
    size = np.diff(np.append(first, len(held)))
    place = np.arange(len(held)) - np.repeat(first, size)
    power = np.cumprod(np.concatenate(([1], np.full(int(size.max()), _P, np.uint32))).astype(np.uint32), dtype=np.uint32)
    h = _mixed(np.add.reduceat((low[held] + np.uint32(1)) * power[place], first, dtype=np.uint32))
    upper = np.add.reduceat((kind[held] == UPPER).astype(np.int64), first)
    digit = np.add.reduceat((kind[held] == DIGIT).astype(np.int64), first)
    case = np.where(kind[start] == MARK, 5, np.where(digit > 0, 4, np.where(upper == 0, 0, np.where((upper == 1) & (kind[start] == UPPER), 1,
                    np.where(upper == size, 3, 2)))))
    length = np.searchsorted([2, 4, 8, 16], size)
    _, at, own = np.unique(h, return_index=True, return_inverse=True)
    seen = (at[own] != np.arange(len(h))).astype(np.int64)
    seen[1:] += h[1:] == h[:-1]
    return h, _mixed((case * 64 + length * 4 + seen + 1).astype(np.uint32) * np.uint32(0x9E3779B1))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct slots, values) of a text; none for a null text or one without tokens."""
    slots, values = [], []
    for salt, (stream, orders) in enumerate(zip(tokens(text), (WORD_ORDERS, FORM_ORDERS))):
        found, h = [], stream + np.uint32(salt + 1)
        for n in range(1, max(orders) + 1):
            if n > 1:
                h = _mixed(h[:-1]) * np.uint32(3) + stream[n - 1:]
            if n in orders:
                found.append(_mixed(h) >> np.uint32(32 - HASH_BITS))
        slot, count = np.unique(np.concatenate(found), return_counts=True)
        if len(slot):
            slots.append(slot.astype(np.int32))
            values.append(np.sqrt(count / count.sum()).astype(np.float32))
    if not slots:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    return np.concatenate(slots), np.concatenate(values)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The FTRL-proximal weights of a state."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(state: tuple[np.ndarray, np.ndarray], slots: np.ndarray, values: np.ndarray, y: int) -> None:
    """One update of ``state`` (in place) by one row; the last slot is the intercept."""
    z, n = state
    slots, values = np.append(slots, len(z) - 1), np.append(values, np.float32(1)).astype(np.float64)
    w = weights(z[slots], n[slots])
    g = (1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - y) * values
    # A slot that both streams hit is in the row twice; add.at counts both.
    step = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / ALPHA
    np.add.at(z, slots, g - step * w)
    np.add.at(n, slots, g * g)


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights (one per slot, the intercept last), fitted on the rows of ``docs`` that
    ``labels`` marks 0 or 1 and ``allowed`` (an expression over the column ``id``) admits.

    Rows with a null id or label are not used; an id that ``labels`` marks both 0 and
    1 counts as 0.  Of repeated ids in ``docs`` one row is learnt from, that with the
    smallest hash of its text.  Without any row the weights are zero (score one half).
    """
    spark = docs.sparkSession
    marks = pick(labels, id_col, label_col).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    marks = marks.where("id is not null and y in (0, 1)")
    if allowed is not None:
        marks = marks.where(allowed)
    marks = marks.groupBy("id").agg(F.min("y").cast("int").alias("y")).withColumn("at", F.xxhash64("id"))
    # At most 2 * max_rows ids: small enough to broadcast by construction.
    chosen = [marks.where(F.col("y") == y).orderBy("at", "id").limit(max_rows) for y in (0, 1)]
    chosen = stored(chosen[0].unionByName(chosen[1]), "quality-ids")
    learners = max(1, -(-chosen.count() // ROWS_PER_LEARNER))
    chosen = chosen.withColumn("learner", F.pmod("at", F.lit(learners)).cast("int"))
    size = (1 << HASH_BITS) + 1

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {}  # smallest hash so far of each id: of a repeated id only ever smaller ones go on
        for b in batches:
            rows = []
            for i, (key, tie) in enumerate(zip(b.column("id").to_pylist(), b.column("tie").to_pylist())):
                if key not in least or tie < least[key]:
                    least[key] = tie
                    rows.append(i)
            b = b.take(pa.array(rows, pa.int64()))
            x = [features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "y", "at", "learner", "tie")), pa.array([s.tobytes() for s, _ in x], pa.binary()),
                                              pa.array([v.tobytes() for _, v in x], pa.binary())], names=["id", "y", "at", "learner", "tie", "slots", "vals"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of a learner go to a file that is in memory while it is small, and from there through the updates."""
        now, last, marks_of, sizes, file = None, None, [], [], None

        def done() -> pa.RecordBatch:
            state = np.zeros(size), np.zeros(size)
            for _ in range(EPOCHS):
                file.seek(0)
                for y, n in zip(marks_of, sizes):
                    data = file.read(8 * n)
                    learn(state, np.frombuffer(data, np.int32, n), np.frombuffer(data, np.float32, n, 4 * n), y)
            file.close()
            packed = [pa.array([s.astype(np.float32).tobytes()], pa.binary()) for s in state]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(sizes)], pa.int64()), *packed], names=["learner", "n_rows", "z", "n"])

        for b in batches:
            for who, key, y, s, v in zip(*(b.column(c) for c in ("learner", "id", "y", "slots", "vals"))):
                if who.as_py() != now:
                    if file is not None:
                        yield done()
                    now, last, marks_of, sizes, file = who.as_py(), None, [], [], tempfile.SpooledTemporaryFile(SPOOL_BYTES)
                if key.as_py() == last:  # the same id again, with a larger hash
                    continue
                last = key.as_py()
                file.write(s.as_buffer())
                file.write(v.as_buffer())
                marks_of.append(y.as_py())
                sizes.append(len(s.as_buffer()) // 4)
        if file is not None:
            yield done()

    bounded_batches(spark)
    texts = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").withColumn("tie", F.xxhash64("text"))
    kind = sample.schema["id"].dataType.simpleString()
    sample = sample.mapInArrow(featurise, f"id {kind}, y int, at long, learner int, tie long, slots binary, vals binary")
    dealt = sample.repartition(learners, "learner").sortWithinPartitions("learner", F.xxhash64("at"), "id", "tie")
    # One state per learner, of a fixed size; their number is bounded by max_rows.
    states = dealt.select("learner", "id", "y", "slots", "vals").mapInArrow(fit, "learner int, n_rows long, z binary, n binary")
    total, z, n = 0, np.zeros(size), np.zeros(size)
    for r in sorted(states.collect(), key=lambda r: r["learner"]):
        total += r["n_rows"]
        z += np.frombuffer(r["z"], np.float32) * np.float64(r["n_rows"])
        n += np.frombuffer(r["n"], np.float32) * np.float64(r["n_rows"])
    return weights(z / max(total, 1), n / max(total, 1)).astype(np.float32)


def _scores(texts: pa.Array, w: np.ndarray) -> np.ndarray:
    z = np.empty(len(texts))
    for i, t in enumerate(texts):
        slots, values = features(t.as_py())
        z[i] = w[slots].astype(np.float64) @ values + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row: the modelled probability that the text is of good
    quality.  Null and empty texts get the score of no features."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(b.column(1), handle.value))], names=["id", "score"])

    bounded_batches(docs.sparkSession)
    part = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return part.mapInArrow(run, f"id {part.schema['id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: np.ndarray, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` (all columns) that score ``threshold`` or more; the decision is
    taken next to the text, so nothing is shuffled."""
    handle, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(b.column(at), handle.value) >= threshold))

    bounded_batches(docs.sparkSession)
    rows = numbered(docs)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
