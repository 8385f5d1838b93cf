"""Structured Streaming operators T1-T8 over landed transfer events.

Every operator takes and returns a streaming DataFrame; :func:`run_stream`
drives one into a durable table with ``foreachBatch`` (idempotent per batch
id, so a batch replayed after an executor loss overwrites its own output).
Checkpoints live under the cluster's ``spark.checkpoint.dir``.

Event time: the landed events carry ``TIMESTAMP_NTZ``; watermarks need
``TIMESTAMP``, so :func:`event_time` converts through epoch microseconds
(the wall clock is read as UTC, whatever the session zone).
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.progress import epoch_micros
from ..schemas import CHUNK_REQUEUE_BUDGET
from .compact import compact, read_current

# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def event_time(ts) -> Column:
    """TIMESTAMP_NTZ -> TIMESTAMP at the same UTC wall clock."""
    return F.timestamp_micros(epoch_micros(ts))


def stream_source(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of landed events (fixed schema, no inference)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


# --------------------------------------------------------------------------- T1
def stream_latest(events: DataFrame, run: str = "run_id", order: Sequence[str] = ("ts", "event_id"),
                  value_cols: Sequence[str] | None = None) -> DataFrame:
    """Keyed latest state -- ``max_by`` per run kept in the state store
    (update mode emits the runs that changed in a batch)."""
    cols = list(value_cols or [c for c in events.columns if c != run])
    key = F.struct(*[F.col(c) for c in order])
    agg = events.groupBy(run).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), key).alias("_last"))
    return agg.select(run, *[F.col(f"_last.{c}").alias(c) for c in cols])


def stream_final(events: DataFrame, run: str = "run_id", ts: str = "event_ts", order: Sequence[str] = ("ts", "event_id"),
                 value_cols: Sequence[str] | None = None, idle: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """T1 with an end: the last event of a run once it has been idle for ``idle``
    before the event-time watermark (output mode append).

    A run's state lives as long as its events are closer than ``idle``; then the watermark
    closes it, its final row is emitted and the state is forgotten, so the store holds the
    runs of the last while, not all there ever were.  A run that goes on later has another
    final row; the newest one counts (:func:`read_updates` on the sink)."""
    cols = list(value_cols or [c for c in events.columns if c not in (run, ts)])
    last = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order]))
    agg = (events.withWatermark(ts, lateness).groupBy(F.session_window(ts, idle).alias("s"), run)
           .agg(last.alias("_last"), F.count(F.lit(1)).alias("events")))
    return agg.select(run, *[F.col(f"_last.{c}").alias(c) for c in cols], "events", F.col("s.end").alias("closed_at"))


# --------------------------------------------------------------------------- T2, T3
def stream_speed(events: DataFrame, ts: str = "event_ts", feed: str = "run_id", bytes_: str = "bytes_done",
                 window: str = "3 seconds", slide: str = "1 second", lateness: str = "10 seconds") -> DataFrame:
    """Sliding-window throughput per feed: (max - min bytes) / window
    seconds, emitted once a window is closed by the watermark."""
    from ..operators.progress import _interval_micros
    secs = _interval_micros(window) / 1e6
    return (events.withWatermark(ts, lateness)
            .groupBy(F.window(ts, window, slide).alias("w"), feed)
            .agg(F.max(bytes_).alias("max_bytes"), F.min(bytes_).alias("min_bytes"), F.count(F.lit(1)).alias("samples"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), feed, "samples",
                    ((F.col("max_bytes") - F.col("min_bytes")) / F.lit(secs)).alias("bytes_per_s")))


def stream_counts(events: DataFrame, ts: str = "event_ts", key: str = "stage", window: str = "1 day",
                  lateness: str = "1 hour") -> DataFrame:
    """Tumbling-window counts by a status/level column."""
    return (events.withWatermark(ts, lateness)
            .groupBy(F.window(ts, window).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), key, "n"))


# --------------------------------------------------------------------------- T4
def stream_sessions(events: DataFrame, ts: str = "event_ts", run: str = "run_id", gap: str = "30 minutes",
                    lateness: str = "1 hour") -> DataFrame:
    """T4: transfer sessions -- events of a run closer than ``gap`` form one
    session (register ... unregister/complete/fail)."""
    return (events.withWatermark(ts, lateness)
            .groupBy(F.session_window(ts, gap).alias("s"), run)
            .agg(F.count(F.lit(1)).alias("events"), F.max("bytes_done").alias("max_bytes"))
            .select(run, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "events", "max_bytes"))


# --------------------------------------------------------------------------- T5
_RETRY_OUT = "file_id string, chunk_id long, failures long, status string"
_RETRY_CHUNKS = pa.schema([("file_id", pa.string()), ("chunk_id", pa.int64()), ("failures", pa.int64()),
                           ("reported", pa.bool_()), ("deadline_ms", pa.int64())])
_RETRY_STATE = "chunks binary"  # an Arrow table: a row per chunk (:func:`_pack`)


def _pack(chunks: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(chunks, schema=_RETRY_CHUNKS, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(packed).read_all().to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


def _ranks(col: pd.Series) -> np.ndarray:
    """Values that sort as the column does, nulls last."""
    if col.dtype != object:
        return col.to_numpy()
    codes, uniques = pd.factorize(col, sort=True)
    return np.where(codes < 0, len(uniques), codes)


def stream_retries(attempts: DataFrame, budget: int = CHUNK_REQUEUE_BUDGET, timeout: str = "1 hour",
                   ts: str = "event_ts", order: Sequence[str] = ("seq",), groups: int = 256) -> DataFrame:
    """T5: retry state machine per (file, chunk) with ``applyInPandasWithState``.

    Failures are counted; the (budget+1)-th failure emits ``fatal``; a success
    emits ``done``.  A chunk whose newest event lies more than ``timeout`` before
    the event-time watermark emits ``stalled`` (if it never finished) and is
    forgotten.  An attempt without an event time counts as one at the watermark.
    Output mode append.

    The chunks are spread by hash over ``groups`` state rows, each a table of its
    chunks with their own deadlines, and a group's attempts are counted together:
    the cost of a call into Python and of its Arrow batches is paid per group and
    micro-batch, not per file.  A group is read and written whole, so take as many
    as leave some thousand attempts to each in a micro-batch; the number is fixed
    by a query's first start.
    """
    t_ms = _ms(timeout)
    order = list(order)
    keys = ["file_id", "chunk_id"]

    def step(key, pdfs: Iterable[pd.DataFrame], state):
        wm = state.getCurrentWatermarkMs()
        held = _unpack(bytes(state.get[0])) if state.exists else _RETRY_CHUNKS.empty_table().to_pandas()
        names, n_held = held[keys].astype({"file_id": object, "chunk_id": "Int64"}), len(held)
        fails, rep = held["failures"].to_numpy("int64"), held["reported"].to_numpy(bool)
        dl = held["deadline_ms"].to_numpy("int64")
        done = []
        if not state.hasTimedOut:
            pdf = pd.concat(list(pdfs), ignore_index=True)
            both = pd.concat([names, pdf[keys].astype({"file_id": object, "chunk_id": "Int64"})], ignore_index=True)
            no = both.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()  # held chunks keep their row number
            names = both[~both.duplicated()].reset_index(drop=True)
            more, no = len(names) - n_held, no[n_held:]
            fails, rep = np.append(fails, np.zeros(more, "int64")), np.append(rep, np.zeros(more, bool))
            dl = np.append(dl, np.full(more, np.iinfo("int64").min))
            at = pdf[ts].to_numpy().astype("datetime64[ms]")
            # by the chunk's own newest event, whatever the watermark is by now
            np.maximum.at(dl, no, np.where(np.isnat(at), wm, at.astype("int64")) + t_ms)
            idx = np.lexsort([*[_ranks(pdf[c]) for c in reversed(order)], no])
            row, ok = no[idx], pdf["ok"].eq(True).fillna(False).to_numpy(bool)[idx]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            last = np.r_[first[1:], len(row)] - 1
            upto = np.cumsum(~ok)
            before = np.repeat(upto[first] - ~ok[first], last - first + 1)
            count = upto - before + fails[row]
            ends = np.flatnonzero((ok | (count > budget)) & ~rep[row])
            ended, at_end = np.unique(row[ends], return_index=True)
            ends = ends[at_end]
            fails[row[last]] = count[last]
            fails[ended], rep[ended] = count[ends], True
            done.append((ended, np.where(ok[ends], "done", "fatal")))
        over = dl < wm
        stalled = np.flatnonzero(over & ~rep)
        done.append((stalled, np.full(len(stalled), "stalled")))
        if not over.all():
            state.update((_pack(names.assign(failures=fails, reported=rep, deadline_ms=dl)[~over]),))
            state.setTimeoutTimestamp(int(dl[~over].min()))
        elif state.exists:
            state.remove()
        out = np.concatenate([i for i, _ in done])
        if len(out):
            yield names.take(out).assign(failures=fails[out], status=np.concatenate([s for _, s in done]).astype(object))

    return (attempts.withWatermark(ts, timeout)
            .withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups)))
            .groupBy("_group")
            .applyInPandasWithState(step, _RETRY_OUT, _RETRY_STATE, "append", GroupStateTimeout.EventTimeTimeout))


def _ms(interval: str) -> int:
    from ..operators.progress import _interval_micros
    return _interval_micros(interval) // 1000


# --------------------------------------------------------------------------- T6
def stream_dedupe(events: DataFrame, keys: Sequence[str] = ("event_id",), ts: str = "event_ts",
                  lateness: str = "1 hour") -> DataFrame:
    """Drop exact re-deliveries of the same key within the watermark
    delay (keeps the first; for replace-by-id use :func:`stream_latest`)."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))


# --------------------------------------------------------------------------- T8
def late_policy(events: DataFrame, ts: str = "event_ts", lateness: str = "1 hour") -> DataFrame:
    """The late-data policy -- rows older than the watermark are dropped
    by the stateful operator that follows; Spark reports how many in the
    query progress (``numRowsDroppedByWatermark``, see :func:`dropped_late`)."""
    return events.withWatermark(ts, lateness)


def dropped_late(query) -> int:
    """Rows dropped by the watermark over the progress updates the query still holds
    (Spark keeps the last ``spark.sql.streaming.numRecentProgressUpdates``); a
    :class:`DroppedLate` listener counts them over a query's whole life."""
    n = 0
    for p in query.recentProgress:
        for op in p.stateOperators:
            n += int(getattr(op, "numRowsDroppedByWatermark", 0) or 0)
    return n


class DroppedLate(StreamingQueryListener):
    """Counts, per query id, the rows that its watermark dropped, update by
    update: ``spark.streams.addListener(d := DroppedLate())``, then ``d.rows``."""

    def __init__(self):
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event):
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event):
        n = sum(int(op.numRowsDroppedByWatermark or 0) for op in event.progress.stateOperators)
        self.rows[str(event.progress.id)] = self.rows.get(str(event.progress.id), 0) + n

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def run_late_split(events: DataFrame, sink_path: str, checkpoint: str, ts: str = "event_ts", lateness: str = "1 hour",
                   available_now: bool = True, processing_time: str | None = None):
    """T8 with the late rows kept: rows older than the watermark go to ``late``, the
    others to ``on_time`` (two tables under ``sink_path``, read by :func:`read_split`), and
    what was counted per batch to ``marks``.

    The watermark of a batch is the newest event time of all batches before it less
    ``lateness``, as Spark's own stateful operators take it; rows without an event time are
    on time.  A batch writes its own folders and reads the mark of the one before, so a
    replayed batch puts its rows where it did before.  On-time and late rows together are the input."""
    delay, root = _ms(lateness) * 1000, sink_path.rstrip("/")

    def write(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        mark = None
        if batch_id > 0:
            mark = spark.read.parquet(f"{root}/marks/batch_id={batch_id - 1}").first()["newest_us"]
        us = F.unix_micros(F.col(ts))
        late = F.lit(False) if mark is None else F.coalesce(us < F.lit(mark - delay), F.lit(False))
        out = f"{root}/rows/batch_id={batch_id}"
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(out)
        done = spark.read.schema(batch.schema.add("late", "boolean")).parquet(out)
        counts = done.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("late").alias("late_rows"), F.max(us).alias("newest_us"))
        counts = counts.withColumn("newest_us", F.greatest("newest_us", F.lit(mark).cast("long")))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/batch_id={batch_id}")

    w = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    return w.start()


def read_split(spark: SparkSession, sink_path: str, schema) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(on-time rows, late rows, marks) of :func:`run_late_split`; ``schema`` is the events'."""
    root = sink_path.rstrip("/")
    typed = T.StructType([*schema.fields, T.StructField("late", T.BooleanType()), T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(typed).parquet(f"{root}/rows")
    return rows.where("not late").drop("late"), rows.where("late").drop("late"), spark.read.parquet(f"{root}/marks")


# --------------------------------------------------------------------------- sinks / driver
def run_stream(df: DataFrame, sink_path: str, checkpoint: str, mode: str = "append",
               available_now: bool = True, processing_time: str | None = None,
               state_partitions: int | None = None, compact_keys: Sequence[str] | None = None, compact_every: int = 100):
    """Drive a streaming frame into parquet under ``sink_path``.

    * append: each batch is written to ``batch_id=<n>`` with overwrite, so a
      replayed batch replaces its own output (exactly-once result);
    * complete: each batch replaces the whole table;
    * update: each batch's changed rows land in ``batch_id=<n>``; read the
      current state with :func:`read_updates`.

    With ``compact_keys`` every ``compact_every``-th batch first merges those before
    it, which are complete by then, into a snapshot (:mod:`.compact`).

    ``state_partitions`` sets the state-store partition count of a new query
    (it cannot change later without a new checkpoint).
    """
    def write(batch: DataFrame, batch_id: int):
        if mode == "complete":
            batch.write.mode("overwrite").parquet(sink_path)
        else:
            if compact_keys and batch_id and batch_id % compact_every == 0:
                compact(batch.sparkSession, sink_path, compact_keys, batch_id - 1)
            batch.write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch_id={batch_id}")

    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    if not state_partitions:
        return w.start()
    # the number of state-store partitions is fixed when a query first starts;
    # the query runs on a clone of the session taken at start(), so the
    # caller's setting is restored right after
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        return w.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def read_updates(spark: SparkSession, sink_path: str, keys: Sequence[str]) -> DataFrame:
    """Current state of an update-mode sink: per key the row of the latest
    batch (a partial-aggregating ``max_by`` over the current snapshot, if the
    sink has been compacted, and the batches after it)."""
    return read_current(spark, sink_path, keys)


def ingest_incremental(spark: SparkSession, src: str, dst: str, checkpoint: str, schema, fmt: str = "parquet",
                       transform=None, compact_keys: Sequence[str] | None = None, compact_every: int = 100):
    """Incremental ingest of newly landed files into a table.

    The file source records processed files in the checkpoint, so a re-run
    adds only new files (0 rows when nothing new landed).  ``transform`` is
    applied per batch (e.g. the listing clean-up).  Each batch lands in its
    own ``batch_id=<n>`` folder; the current table (an upsert by key, e.g.
    bucket + key with the newest etag/size) is ``read_updates(spark, dst,
    keys)``.  With ``compact_keys`` every ``compact_every``-th batch merges
    the folders before it."""
    stream = stream_source(spark, src, schema, fmt)
    if transform is not None:
        stream = transform(stream)
    q = run_stream(stream, dst, checkpoint, mode="append", compact_keys=compact_keys, compact_every=compact_every)
    q.awaitTermination()
    return q


def status_counts_stream(latest_sink: DataFrame, total=None) -> DataFrame:
    """T1 read side: status counts of the current latest state."""
    from ..operators.progress import status_counts
    return status_counts(latest_sink, total)
