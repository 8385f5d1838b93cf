"""Streaming queries (S12, T1-T8): each lands the driver table in parts, one per
micro-batch, derives the domain view on the stream, runs it to completion with
``availableNow`` into a parquet sink in the shared checkpoint folder and returns
the sink as a DataFrame.  The
oracles are the batch definitions, restricted where append mode only emits
windows the final watermark has closed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fixtures import VIEWS, register_tables, view, with_views
from ..fixtures import table as table_scan
from ..operators.progress import status_counts
from ..session import scratch_path
from ..sources.tagged import read_tagged
from ..streaming.streams import (event_time, ingest_incremental, read_split, read_updates, run_late_split, run_stream, stream_counts,
                                 stream_dedupe, stream_final, stream_latest, stream_retries, stream_sessions, stream_source, stream_speed)
from . import register

ATTEMPT_ORDER = ["p", "q", "n", "x", "dsc", "tx", "ok", "kind", "progressed"]


def _land(rows, part, src: str, batches: int = 3) -> int:
    """Write ``rows`` in parts that land one after another, each in as many files;
    returns that number, which read per trigger makes a part one micro-batch."""
    rows = rows.withColumn("_part", part)
    counts = [r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()]  # one row per part
    files = max(1, min([rows.sparkSession.sparkContext.defaultParallelism, *[n // 64 for n in counts]]))
    for b in range(batches):
        rows.where(F.col("_part") == b).drop("_part").repartition(files).write.mode("append").parquet(src)
    return files


def _by_time(rows, col: str, batches: int = 3):
    """The part of a row when parts follow each other in ``col``."""
    us = F.unix_micros(F.col(col).cast("timestamp"))
    lo, hi = rows.agg(F.min(us), F.max(us)).first()
    return F.least(F.floor((us - lo) * batches / max(1, hi - lo)), F.lit(batches - 1))


def _landed_view(spark, sf, table: str, view: str, name: str, batches: int = 3, by_time: str | None = None):
    """Streaming version of a fixture view over files that landed one after
    another: the table is written in ``batches`` parts and read a part per
    micro-batch, so that state has to carry over from batch to batch.  With
    ``by_time`` the parts follow each other in that column, so none is late."""
    register_tables(spark, sf, [table] + (["orders"] if table == "events" else []))
    rows, src = table_scan(spark, sf, table), scratch_path(spark, f"landed_{name}_{uuid.uuid4().hex}")
    part = _by_time(rows, by_time, batches) if by_time else F.pmod(F.xxhash64(*rows.columns), F.lit(batches))
    files = _land(rows, part, src, batches)
    stream_source(spark, src, rows.schema, max_files_per_trigger=files).createOrReplaceTempView(f"{table}_landed_{name}")
    df = spark.sql(VIEWS[view].replace(f"FROM {table}", f"FROM {table}_landed_{name}"))
    return df.withColumn("event_ts", event_time("ts"))


def _run(df, out, ck, mode, **compaction):
    """Run to completion with one state partition per core."""
    par = df.sparkSession.sparkContext.defaultParallelism
    run_stream(df, out, ck, mode=mode, state_partitions=par, **compaction).awaitTermination()


def _paths(spark, name):
    tag = uuid.uuid4().hex
    return scratch_path(spark, f"stream_{name}_{tag}/out"), scratch_path(spark, f"stream_{name}_{tag}/ckpt")


# ----------------------------------------------------------------- T1 (+ A2)
def q_stream_status_counts(spark, sf):
    ev = _landed_view(spark, sf, "events", "transfer_events", "t1").drop("event_ts")
    out, ck = _paths(spark, "t1")
    _run(stream_latest(ev), out, ck, "update")
    latest = read_updates(spark, out, ["run_id"])
    total = view(spark, sf, "run_report").agg(F.count(F.lit(1)).alias("total"))
    c = status_counts(latest, total)
    return c.select(*[F.col(x).cast("bigint").alias(x) for x in ("completed", "failed", "active", "queued", "total")])


register("stream_status_counts", with_views("""latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY
    run_id ORDER BY ts DESC, event_id DESC) AS rn FROM transfer_events) z WHERE rn = 1),
c AS (SELECT count_if(stage = 'completed') AS completed, count_if(stage = 'failed') AS failed,
    count_if(stage IN ('downloading', 'extracting', 'compressing')) AS active FROM latest),
t AS (SELECT count(*) AS total FROM run_report)
SELECT cast(completed AS BIGINT) AS completed, cast(failed AS BIGINT) AS failed, cast(active AS BIGINT) AS active,
  cast(greatest(0, total - completed - failed - active) AS BIGINT) AS queued, cast(total AS BIGINT) AS total
FROM c, t""", "transfer_events", "run_report"))(q_stream_status_counts)


# ----------------------------------------------------------------- T3
def q_stream_window_counts(spark, sf):
    # update mode: each batch writes only the windows it changed, and the watermark drops old ones from the state
    ev = _landed_view(spark, sf, "events", "transfer_events", "t3", by_time="ts")
    out, ck = _paths(spark, "t3")
    _run(stream_counts(ev, "event_ts", "stage", "1 day", "1 hour"), out, ck, "update",
         compact_keys=["window_start", "stage"], compact_every=2)
    r = read_updates(spark, out, ["window_start", "stage"])
    return r.select(F.unix_micros("window_start").alias("window_start_us"), "stage", F.col("n").cast("bigint").alias("n"))


register("stream_window_counts", with_views("""SELECT epoch_us(date_trunc('day', ts)) AS window_start_us, stage,
  cast(count(*) AS BIGINT) AS n FROM transfer_events GROUP BY 1, 2""", "transfer_events"))(q_stream_window_counts)


# ----------------------------------------------------------------- T2
def q_stream_speed(spark, sf):
    ev = _landed_view(spark, sf, "events", "transfer_events", "t2", by_time="ts")
    out, ck = _paths(spark, "t2")
    _run(stream_speed(ev, "event_ts", "run_id", "bytes_done", "6 hours", "1 hour", "1 hour"), out, ck, "append")
    r = spark.read.parquet(out)
    return r.select(F.unix_micros("window_start").alias("window_start_us"), "run_id",
                    F.col("samples").cast("bigint").alias("samples"), F.round("bytes_per_s", 6).alias("bytes_per_s"))


register("stream_speed", with_views("""e AS (SELECT run_id, bytes_done, epoch_us(ts) AS us FROM transfer_events),
w AS (SELECT run_id, bytes_done, (us // 3600000000 - k) * 3600000000 AS ws
  FROM e, range(0, 6) r(k)),
m AS (SELECT max(us) - 3600000000 AS wm FROM e)
SELECT ws AS window_start_us, run_id, cast(count(*) AS BIGINT) AS samples,
  round((max(bytes_done) - min(bytes_done)) / 21600.0, 6) AS bytes_per_s
FROM w, m WHERE ws + 21600000000 <= wm GROUP BY ws, run_id""", "transfer_events"))(q_stream_speed)


# ----------------------------------------------------------------- T4
def q_stream_sessions(spark, sf):
    ev = _landed_view(spark, sf, "events", "transfer_events", "t4", by_time="ts")
    out, ck = _paths(spark, "t4")
    _run(stream_sessions(ev, "event_ts", "run_id", "6 hours", "1 hour"), out, ck, "append")
    r = spark.read.parquet(out)
    return r.select("run_id", F.unix_micros("session_start").alias("start_us"),
                    F.unix_micros("session_end").alias("end_us"), F.col("events").cast("bigint").alias("events"),
                    "max_bytes")


register("stream_sessions", with_views("""e AS (SELECT run_id, bytes_done, epoch_us(ts) AS us FROM transfer_events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY run_id ORDER BY us) < 21600000000 THEN 0 ELSE 1 END AS brk
  FROM e),
s AS (SELECT *, sum(brk) OVER (PARTITION BY run_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS sid FROM g),
x AS (SELECT run_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, cast(count(*) AS BIGINT) AS events,
    max(bytes_done) AS max_bytes FROM s GROUP BY run_id, sid),
m AS (SELECT max(us) - 3600000000 AS wm FROM e)
SELECT run_id, start_us, end_us, events, max_bytes FROM x, m WHERE end_us <= wm""",
                                       "transfer_events"))(q_stream_sessions)


# ----------------------------------------------------------------- T1 with an end
def q_stream_final_states(spark, sf):
    ev = _landed_view(spark, sf, "events", "transfer_events", "t1f", by_time="ts")
    out, ck = _paths(spark, "t1f")
    _run(stream_final(ev, idle="6 hours", lateness="1 hour"), out, ck, "append")
    r = spark.read.parquet(out)
    return r.select("run_id", "event_id", "stage", "bytes_done", F.col("events").cast("bigint").alias("events"),
                    F.unix_micros("closed_at").alias("closed_us"))


register("stream_final_states", with_views("""e AS (SELECT run_id, event_id, stage, bytes_done, epoch_us(ts) AS us FROM transfer_events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY run_id ORDER BY us) < 21600000000 THEN 0 ELSE 1 END AS brk FROM e),
s AS (SELECT *, sum(brk) OVER (PARTITION BY run_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS sid FROM g),
x AS (SELECT *, count(*) OVER (PARTITION BY run_id, sid) AS events, max(us) OVER (PARTITION BY run_id, sid) + 21600000000 AS closed_us,
    row_number() OVER (PARTITION BY run_id, sid ORDER BY us DESC, event_id DESC) AS rn FROM s),
m AS (SELECT max(us) - 3600000000 AS wm FROM e)
SELECT run_id, event_id, stage, bytes_done, cast(events AS BIGINT) AS events, closed_us FROM x, m
WHERE rn = 1 AND closed_us <= wm""", "transfer_events"))(q_stream_final_states)


# ----------------------------------------------------------------- S12
def q_stream_tagged_events(spark, sf):
    """One JSON stream of several kinds of events, dispatched by tag, bad lines among them."""
    lines, src = view(spark, sf, "tagged_lines"), scratch_path(spark, f"tagged_{uuid.uuid4().hex}")
    lines.select("line").write.text(src)
    out, ck = _paths(spark, "s12")
    _run(read_tagged(spark, src), out, ck, "append")
    r = spark.read.parquet(out)
    return r.select("tag", "progress.run_id", "progress.percent", "progress.status", "progress.speed_mbps", "log.level",
                    F.coalesce("log.message", "error.message").alias("message"), "started.total", "reason",
                    F.when(F.col("reason").isNotNull(), F.md5("value")).alias("line_md5"))


register("stream_tagged_events", with_views("""t AS (SELECT l.line, l.k, e.* FROM tagged_lines l JOIN transfer_events e USING (event_id))
SELECT CASE k WHEN 0 THEN 'Log' WHEN 1 THEN 'Started' WHEN 2 THEN 'Error' WHEN 3 THEN 'Paused' WHEN 4 THEN NULL WHEN 6 THEN 'Completed' WHEN 7 THEN 'Started' ELSE 'Progress' END AS tag,
  CASE WHEN k >= 8 THEN run_id END AS run_id, CASE WHEN k >= 8 THEN cast(bytes_done % 100 AS DOUBLE) END AS percent,
  CASE WHEN k >= 8 THEN stage END AS status, CASE WHEN k >= 8 THEN bytes_done % 1000 + 0.5::DOUBLE END AS speed_mbps,
  CASE k WHEN 0 THEN 'INFO' END AS level, CASE k WHEN 0 THEN 'run ' || run_id WHEN 2 THEN coalesce(error, 'none') END AS message,
  CASE k WHEN 1 THEN bytes_done END AS total,
  CASE WHEN k = 3 THEN 'unknown type' WHEN k = 4 THEN 'bad json' WHEN k IN (5, 7) THEN 'bad data' END AS reason,
  CASE WHEN k IN (3, 4, 5, 7) THEN md5(line) END AS line_md5
FROM t""", "transfer_events", "tagged_lines"))(q_stream_tagged_events)


# ----------------------------------------------------------------- T8
def q_stream_late_split(spark, sf):
    """A tenth of the events lands a part later than its time: those behind the
    watermark by then are kept in a table of their own."""
    rows, src = view(spark, sf, "transfer_events"), scratch_path(spark, f"late_{uuid.uuid4().hex}")
    part = _by_time(rows, "ts") + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    files = _land(rows, part, src, 4)
    stream = stream_source(spark, src, rows.schema, max_files_per_trigger=files).withColumn("event_ts", event_time("ts"))
    out, ck = _paths(spark, "t8")
    run_late_split(stream, out, ck, lateness="1 hour").awaitTermination()
    on_time, late, marks = read_split(spark, out, stream.schema)
    counted = marks.agg(F.sum("late_rows").alias("late_total"))
    rows = on_time.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))
    return rows.crossJoin(F.broadcast(counted))  # one row


register("stream_late_split", with_views("""e AS (SELECT event_id, epoch_us(ts) AS us FROM transfer_events),
b AS (SELECT min(us) AS lo, max(us) AS hi FROM e),
p AS (SELECT event_id, us, least(floor((us - lo) * 3 / (hi - lo)), 2) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS part FROM e, b),
m AS (SELECT part, max(max(us)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000000 AS wm FROM p GROUP BY part),
l AS (SELECT event_id, coalesce(us < wm, false) AS late FROM p JOIN m USING (part))
SELECT event_id, late, cast((SELECT count_if(late) FROM l) AS BIGINT) AS late_total FROM l""", "transfer_events"))(q_stream_late_split)


# ----------------------------------------------------------------- T6
def q_stream_dedupe(spark, sf):
    """Every part of the events is delivered again with the one after it."""
    register_tables(spark, sf, ["events", "orders"])
    rows, src = table_scan(spark, sf, "events"), scratch_path(spark, f"landed_t6_{uuid.uuid4().hex}")
    part = _by_time(rows, "ts")
    again = rows.withColumn("_at", F.explode(F.array(F.lit(0), F.lit(1))))
    files = _land(again, part + F.col("_at"), src, 4)
    stream_source(spark, src, again.schema, max_files_per_trigger=files).createOrReplaceTempView("events_landed_t6")
    ev = spark.sql(VIEWS["transfer_events"].replace("FROM events", "FROM events_landed_t6")).withColumn("event_ts", event_time("ts"))
    out, ck = _paths(spark, "t6")
    _run(stream_dedupe(ev, ["event_id"], "event_ts", "1 hour"), out, ck, "append")
    r = spark.read.parquet(out)
    return r.select("event_id", "run_id", "stage", "bytes_done")


register("stream_dedupe", with_views("SELECT event_id, run_id, stage, bytes_done FROM transfer_events",
                                     "transfer_events"))(q_stream_dedupe)


# ----------------------------------------------------------------- T5
def q_stream_retries(spark, sf):
    """Attempts in the order of their ship dates, a third per micro-batch."""
    rows, src = table_scan(spark, sf, "lineitem"), scratch_path(spark, f"landed_t5_{uuid.uuid4().hex}")
    files = _land(rows, _by_time(rows, "l_shipdate"), src)
    stream_source(spark, src, rows.schema, max_files_per_trigger=files).createOrReplaceTempView("lineitem_stream_t5")
    att = spark.sql(_ATTEMPTS_SHIP.replace("FROM lineitem", "FROM lineitem_stream_t5"))
    att = att.withColumn("event_ts", event_time("ship")) \
        .select("file_id", "chunk_id", "event_ts", *ATTEMPT_ORDER)
    out, ck = _paths(spark, "t5")
    # some 8,192 attempts of each third to a group of chunks
    groups = max(2 * spark.sparkContext.defaultParallelism, rows.count() // (3 * 8192))
    _run(stream_retries(att, 3, "1 hour", order=ATTEMPT_ORDER, groups=groups), out, ck, "append")
    r = spark.read.parquet(out)
    return r.select("file_id", "chunk_id", "failures", "status")


_ATTEMPTS_SHIP = VIEWS["chunk_attempts"].replace("l_linenumber - 1 AS bigint) AS chunk_id,",
                                                 "l_linenumber - 1 AS bigint) AS chunk_id, l_shipdate AS ship,")

# A chunk's state lives on from part to part while it has attempts; without any in the next part it is
# forgotten there if its newest one + 1 hour lies before the watermark (newest of the parts before - 1 hour).
register("stream_retries", f"""WITH chunk_attempts AS ({_ATTEMPTS_SHIP.strip()}),
e AS (SELECT *, epoch_ms(cast(ship AS TIMESTAMP)) AS ms FROM chunk_attempts),
x AS (SELECT min(ms) AS lo, max(ms) AS hi FROM e),
a AS (SELECT e.*, least(floor((ms - lo) * 3 / (hi - lo)), 2) AS part FROM e, x),
m AS (SELECT part, max(ms) AS newest FROM a GROUP BY part),
c AS (SELECT file_id, chunk_id, part, max(ms) AS newest FROM a GROUP BY ALL),
g AS (SELECT c.*, lag(part) OVER w AS prior, lag(newest) OVER w AS prior_newest FROM c WINDOW w AS (PARTITION BY file_id, chunk_id ORDER BY part)),
l AS (SELECT g.file_id, g.chunk_id, g.part, sum(CASE WHEN g.prior IS NULL OR (g.part - g.prior > 1 AND g.prior_newest + 7200000 < m.newest) THEN 1 ELSE 0 END)
    OVER (PARTITION BY g.file_id, g.chunk_id ORDER BY g.part) AS life FROM g LEFT JOIN m ON m.part = g.prior),
t AS (SELECT a.*, life, row_number() OVER v AS rn, sum(CASE WHEN NOT ok THEN 1 ELSE 0 END) OVER (v ROWS UNBOUNDED PRECEDING) AS f
  FROM a JOIN l USING (file_id, chunk_id, part) WINDOW v AS (PARTITION BY file_id, chunk_id, life ORDER BY part, {', '.join(ATTEMPT_ORDER)})),
s AS (SELECT *, CASE WHEN ok THEN 'done' WHEN f > 3 THEN 'fatal' END AS st FROM t),
r AS (SELECT file_id, chunk_id, life, arg_min(st, rn) FILTER (WHERE st IS NOT NULL) AS status, arg_min(f, rn) FILTER (WHERE st IS NOT NULL) AS fs,
    max(f) AS total_f, max(ms) AS newest, max(life) OVER (PARTITION BY file_id, chunk_id) AS lives FROM s GROUP BY file_id, chunk_id, life)
SELECT file_id, chunk_id, cast(CASE WHEN status IS NULL THEN total_f ELSE fs END AS BIGINT) AS failures, coalesce(status, 'stalled') AS status
FROM r, x WHERE status IS NOT NULL OR life < lives OR newest + 7200000 < hi""")(q_stream_retries)


# ----------------------------------------------------------------- T7
def q_stream_ingest(spark, sf):
    """Listings that land in two deliveries, the second with newer etags for some
    keys, and a third run that finds nothing new; the table is the newest row per key."""
    src, dst, ck = (scratch_path(spark, f"ingest_{uuid.uuid4().hex}/{d}") for d in ("src", "dst", "ck"))
    rows = view(spark, sf, "object_listing").where(F.col("key").isNotNull()).select("bucket", "key", "size", "etag")
    keyed = rows.groupBy("bucket", "key").agg(F.max("size").alias("size"), F.max("etag").alias("etag"))
    for delivery in (keyed, keyed.where(F.length("key") % 2 == 0).withColumn("etag", F.concat(F.lit("new-"), F.coalesce("etag", F.lit(""))))):
        delivery.write.mode("append").parquet(src)
        ingest_incremental(spark, src, dst, ck, keyed.schema, compact_keys=["bucket", "key"], compact_every=1)
    ingest_incremental(spark, src, dst, ck, keyed.schema, compact_keys=["bucket", "key"], compact_every=1)
    return read_updates(spark, dst, ["bucket", "key"]).select("bucket", "key", "size", "etag")


register("stream_ingest", with_views("""k AS (SELECT bucket, key, max(size) AS size, max(etag) AS etag FROM object_listing
  WHERE key IS NOT NULL GROUP BY bucket, key)
SELECT bucket, key, size, CASE WHEN length(key) % 2 = 0 THEN 'new-' || coalesce(etag, '') ELSE etag END AS etag FROM k""",
                                     "object_listing"))(q_stream_ingest)
