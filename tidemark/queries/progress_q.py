"""Progress, speed and log queries: A2, A7-A10, W1-W3, W6, W7, O2, F9, S10,
S11, X14, X17, X18, K6."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table, view, with_views
from ..functions.columns import avg_speed_mb_s, human_bytes, log_line, stage_percent
from ..operators.filters import log_level
from ..operators.progress import (failure_summary, global_progress, instant_speed, latest_progress,
                                  log_tail, overall_percent, parse_log_lines, progress_weights, running_bytes,
                                  sliding_speed, stage_percents, stage_transitions, status_counts)
from ..operators.runs import process_runs
from ..sinks.writers import export_progress
from ..sources.state import parse_progress
from . import register
from .duck import processed_cte

SPEED_WINDOW = "6 hours"


def _events(spark, sf):
    return view(spark, sf, "transfer_events")


def _latest(spark, sf):
    return latest_progress(_events(spark, sf))


_LATEST_SQL = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id
    ORDER BY ts DESC, event_id DESC) AS rn FROM transfer_events) z WHERE rn = 1)"""


# ----------------------------------------------------------------- W3
def q_latest_progress(spark, sf):
    return _latest(spark, sf).select("run_id", "event_id", "stage", "bytes_done")


register("latest_progress", with_views(f"""{_LATEST_SQL}
SELECT run_id, event_id, stage, bytes_done FROM latest""", "transfer_events"))(q_latest_progress)


# ----------------------------------------------------------------- A2
def q_status_counts(spark, sf):
    total = view(spark, sf, "run_report").agg(F.count(F.lit(1)).alias("total"))
    c = status_counts(_latest(spark, sf), total)
    return c.select(*[F.col(x).cast("bigint").alias(x) for x in ("completed", "failed", "active", "queued", "total")])


register("status_counts", with_views(f"""{_LATEST_SQL},
c AS (SELECT count_if(stage = 'completed') AS completed, count_if(stage = 'failed') AS failed,
    count_if(stage IN ('downloading', 'extracting', 'compressing')) AS active FROM latest),
t AS (SELECT count(*) AS total FROM run_report)
SELECT cast(completed AS BIGINT) AS completed, cast(failed AS BIGINT) AS failed, cast(active AS BIGINT) AS active,
  cast(greatest(0, total - completed - failed - active) AS BIGINT) AS queued, cast(total AS BIGINT) AS total
FROM c, t""", "transfer_events", "run_report"))(q_status_counts)


# ----------------------------------------------------------------- A7
_A7 = """CASE WHEN stage = 'completed' THEN 100.0 ELSE least(CASE WHEN bytes_total > 0
    THEN least(bytes_done / bytes_total * 100.0, 100.0) ELSE 0.0 END, 99.0) END"""


def q_stage_percent(spark, sf):
    e = _events(spark, sf)
    return e.select("event_id", F.round(stage_percent("bytes_done", "bytes_total", F.col("stage") == "completed"), 6)
                    .alias("percent"))


register("stage_percent", with_views(f"SELECT event_id, round({_A7}, 6) AS percent FROM transfer_events",
                                     "transfer_events"))(q_stage_percent)


# ----------------------------------------------------------------- A8
def q_overall_percent(spark, sf):
    p = process_runs(view(spark, sf, "run_report"))
    l = _latest(spark, sf).withColumnRenamed("run_id", "run_accession")
    # every run of the report, those without an event yet as pending
    j = p.join(l, "run_accession", "left").withColumn("stage", F.coalesce("stage", F.lit("pending")))
    ov = overall_percent(stage_percents("stage", "bytes_done", "bytes_total"),
                         progress_weights("fastq_bytes_1", "fastq_bytes_2"), "stage")
    return j.select("run_accession", "stage", F.round(ov, 6).alias("overall_percent"))


register("overall_percent", with_views(f"""{processed_cte()},
{_LATEST_SQL},
j AS (SELECT p.run_accession, coalesce(l.stage, 'pending') AS stage,
    CASE WHEN l.bytes_total > 0 THEN least(least(l.bytes_done / l.bytes_total * 100.0, 100.0), 99.0) ELSE 0.0 END AS run,
    cast(p.fastq_bytes_1 AS DOUBLE) + coalesce(cast(p.fastq_bytes_2 AS DOUBLE), 0.0) AS b
  FROM processed p LEFT JOIN latest l ON l.run_id = p.run_accession),
s AS (SELECT run_accession, stage, b,
    CASE WHEN stage IN ('downloading', 'failed') THEN run
         WHEN stage IN ('extracting', 'compressing', 'completed') THEN 100.0 ELSE 0.0 END AS d,
    CASE WHEN stage = 'extracting' THEN run WHEN stage IN ('compressing', 'completed') THEN 100.0 ELSE 0.0 END AS e,
    CASE WHEN stage = 'compressing' THEN run WHEN stage = 'completed' THEN 100.0 ELSE 0.0 END AS c
  FROM j)
SELECT run_accession, stage, round(CASE WHEN stage = 'completed' THEN 100.0
    WHEN b + b * 3.0 + b * 3.0 = 0 THEN 0.0
    ELSE (d * b + e * (b * 3.0) + c * (b * 3.0)) / (b + b * 3.0 + b * 3.0) END, 6) AS overall_percent
FROM s""", "run_report", "transfer_events"))(q_overall_percent)


# ----------------------------------------------------------------- W2
def _instant(spark, sf):
    return instant_speed(_events(spark, sf), feed="run_id", ts="ts", bytes_="bytes_done", seq="event_id")


_W2_SQL = """w2 AS (SELECT *, CASE WHEN lag(bytes_done) OVER w IS NOT NULL THEN
    greatest(0, bytes_done - lag(bytes_done) OVER w) / 1024.0 / 1024.0
      / greatest((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 1e-6) END AS speed_mbps
  FROM transfer_events WINDOW w AS (PARTITION BY run_id ORDER BY epoch_us(ts), event_id))"""


def q_instant_speed(spark, sf):
    return _instant(spark, sf).select("event_id", F.round("speed_mbps", 6).alias("speed_mbps"))


register("instant_speed", with_views(f"""{_W2_SQL}
SELECT event_id, round(speed_mbps, 6) AS speed_mbps FROM w2""", "transfer_events"))(q_instant_speed)


# ----------------------------------------------------------------- A9
def q_global_progress(spark, sf):
    s = _instant(spark, sf)
    l = latest_progress(s)
    runs = l.select(
        F.when(F.col("stage") == "completed", "Completed").when(F.col("stage") == "failed", "Failed")
        .otherwise("Downloading").alias("status"),
        stage_percent("bytes_done", "bytes_total", F.col("stage") == "completed").alias("percent"),
        "speed_mbps")
    g = global_progress(runs)
    return g.select(F.col("total").cast("bigint").alias("total"), F.col("completed").cast("bigint").alias("completed"),
                    F.col("active").cast("bigint").alias("active"), F.round("percent", 6).alias("percent"),
                    F.round("speed_mbps", 6).alias("speed_mbps"))


register("global_progress", with_views(f"""{_W2_SQL},
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM w2) z WHERE rn = 1),
r AS (SELECT CASE WHEN stage = 'completed' THEN 'Completed' WHEN stage = 'failed' THEN 'Failed'
    ELSE 'Downloading' END AS status, {_A7} AS percent, speed_mbps FROM l)
SELECT cast(count(*) AS BIGINT) AS total, cast(count_if(status = 'Completed') AS BIGINT) AS completed,
  cast(count_if(status <> 'Completed' AND status <> 'Failed') AS BIGINT) AS active,
  round(CASE WHEN count(*) > 0 THEN sum(greatest(0.0, least(100.0, percent))) / count(*) ELSE 0.0 END, 6) AS percent,
  round(coalesce(sum(coalesce(speed_mbps, 0.0)), 0.0), 6) AS speed_mbps
FROM r""", "transfer_events"))(q_global_progress)


# ----------------------------------------------------------------- A10
def q_failure_summary(spark, sf):
    f = failure_summary(_events(spark, sf), seq="event_id")
    return f.select(F.col("failed").cast("bigint").alias("failed"), F.col("total").cast("bigint").alias("total"),
                    "first_error")


register("failure_summary", with_views("""SELECT cast(count_if(error IS NOT NULL) AS BIGINT) AS failed,
  cast(count(*) AS BIGINT) AS total, arg_min(error, event_id) FILTER (WHERE error IS NOT NULL) AS first_error
FROM transfer_events""", "transfer_events"))(q_failure_summary)


# ----------------------------------------------------------------- W1
def q_sliding_speed(spark, sf):
    s = sliding_speed(_events(spark, sf), feed="run_id", ts="ts", bytes_="bytes_done", window=SPEED_WINDOW, seq="event_id")
    return s.select("event_id", F.col("epoch").cast("bigint").alias("epoch"), F.round("speed_bps", 6).alias("speed_bps"))


register("sliding_speed", with_views("""a AS (SELECT *, epoch_us(ts) AS us,
    CASE WHEN bytes_done < lag(bytes_done) OVER (PARTITION BY run_id ORDER BY epoch_us(ts), event_id) THEN 1 ELSE 0 END AS drp
  FROM transfer_events),
b AS (SELECT *, sum(drp) OVER (PARTITION BY run_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS epoch FROM a),
c AS (SELECT *,
    first_value(us) OVER f AS t0, first_value(bytes_done) OVER f AS b0, count(*) OVER f AS n,
    lag(us) OVER e AS tp, lag(bytes_done) OVER e AS bp
  FROM b WINDOW f AS (PARTITION BY run_id, epoch ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW),
    e AS (PARTITION BY run_id, epoch ORDER BY us, event_id)),
d AS (SELECT event_id, epoch, bytes_done, us,
    CASE WHEN n > 1 THEN t0 ELSE coalesce(tp, t0) END AS bt,
    CASE WHEN n > 1 THEN b0 ELSE coalesce(bp, b0) END AS bb FROM c)
SELECT event_id, cast(epoch AS BIGINT) AS epoch,
  round(CASE WHEN us - bt > 0 THEN (bytes_done - bb) / greatest((us - bt) / 1e6, 0.001) ELSE 0.0 END, 6) AS speed_bps
FROM d""", "transfer_events"))(q_sliding_speed)


# ----------------------------------------------------------------- W6
def q_stage_transitions(spark, sf):
    t = stage_transitions(_events(spark, sf))
    return t.select("run_id", "event_id", "from_stage", "to_stage", F.round("seconds_in_from", 6).alias("seconds_in_from"),
                    "illegal")


_ORD = ("CASE {0} WHEN 'pending' THEN 0 WHEN 'downloading' THEN 1 WHEN 'extracting' THEN 2 "
        "WHEN 'compressing' THEN 3 WHEN 'completed' THEN 4 WHEN 'failed' THEN 5 END")

register("stage_transitions", with_views(f"""a AS (SELECT *, lag(stage) OVER (PARTITION BY run_id ORDER BY ts, event_id)
    AS ps FROM transfer_events),
b AS (SELECT * FROM a WHERE ps IS NULL OR ps <> stage),
c AS (SELECT *, lag(stage) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS from_stage,
    lag(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS from_ts FROM b)
SELECT run_id, event_id, from_stage, stage AS to_stage,
  round((epoch_us(ts) - epoch_us(from_ts)) / 1e6, 6) AS seconds_in_from,
  from_stage IN ('completed', 'failed') OR (stage <> 'failed' AND {_ORD.format('stage')} < {_ORD.format('from_stage')})
    AS illegal
FROM c WHERE from_stage IS NOT NULL""", "transfer_events"))(q_stage_transitions)


# ----------------------------------------------------------------- W7
def q_running_bytes(spark, sf):
    r = running_bytes(_events(spark, sf), bytes_="bytes_done")
    return r.select("run_id", "event_id", F.col("running_bytes").cast("bigint").alias("running_bytes"))


register("running_bytes", with_views("""SELECT run_id, event_id, cast(sum(bytes_done) OVER (PARTITION BY run_id
  ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_bytes
FROM transfer_events""", "transfer_events"))(q_running_bytes)


# ----------------------------------------------------------------- S11, F9, O2
def _logs(spark, sf):
    return parse_log_lines(view(spark, sf, "log_lines"))


_LOG_SQL = """lg AS (SELECT event_id, strptime(regexp_extract(line, '^\\[([^\\]]*)\\] \\[([A-Za-z]+)\\] (.*)$', 1),
      '%Y-%m-%d %H:%M:%S.%g') AS ts,
    upper(regexp_extract(line, '^\\[([^\\]]*)\\] \\[([A-Za-z]+)\\] (.*)$', 2)) AS level,
    regexp_extract(line, '^\\[([^\\]]*)\\] \\[([A-Za-z]+)\\] (.*)$', 3) AS message FROM log_lines)"""


def q_log_parse(spark, sf):
    return _logs(spark, sf).select("event_id", "ts", "level", "message")


register("log_parse", with_views(f"""{_LOG_SQL}
SELECT event_id, ts, level, message FROM lg""", "log_lines"))(q_log_parse)


def q_log_level(spark, sf):
    return log_level(_logs(spark, sf), "warn").select("event_id", "level", "message")


register("log_level", with_views(f"""{_LOG_SQL}
SELECT event_id, level, message FROM lg WHERE lower(level) = 'warn'""", "log_lines"))(q_log_level)


def q_log_tail(spark, sf):
    return log_tail(_logs(spark, sf), 101).select("event_id", "level", "message")


register("log_tail", with_views(f"""{_LOG_SQL}
SELECT event_id, level, message FROM lg ORDER BY ts DESC, event_id DESC LIMIT 101""", "log_lines"))(q_log_tail)


# ----------------------------------------------------------------- X17
def q_log_format(spark, sf):
    ev = table(spark, sf, "events")
    lvl = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn") \
        .otherwise("info")
    return ev.select("event_id", log_line("ts", F.upper(lvl), F.concat(F.lit("run "), F.col("user_id").cast("string")))
                     .alias("line"))


register("log_format", """SELECT event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || '] ['
  || upper(CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END) || '] run '
  || cast(user_id AS VARCHAR) AS line FROM events""")(q_log_format)


# ----------------------------------------------------------------- X14
_HB_SQL = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 1024
    WHEN o_orderkey % 11 = 0 THEN 0
    ELSE cast(floor(o_totalprice) AS BIGINT) * CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1024
      WHEN 2 THEN 1048576 WHEN 3 THEN 1073741824 ELSE 1099511627776 END
      + cast(o_custkey AS BIGINT) END AS bytes
FROM orders"""


def q_human_bytes(spark, sf):
    view(spark, sf, "remote_files")
    b = spark.sql(_HB_SQL)
    return b.select("id", "bytes", human_bytes("bytes").alias("text"))


_HB_CASE = "CASE WHEN bytes = 0 THEN '0 B' WHEN bytes < 1024 THEN cast(bytes AS VARCHAR) || ' B'"
for _i, _u in enumerate(["KiB", "MiB", "GiB", "TiB", "PiB"], start=1):
    _lo, _hi = 1024 ** _i, 1024 ** (_i + 1)
    _cond = f"bytes >= {_lo}" + ("" if _u == "PiB" else f" AND bytes < {_hi}")
    _HB_CASE += f" WHEN {_cond} THEN format('{{:.1f}}', bytes / {float(_lo)}) || ' {_u}'"
_HB_CASE += " END"

register("human_bytes", f"""SELECT id, bytes, {_HB_CASE} AS text FROM ({_HB_SQL}) h""")(q_human_bytes)


# ----------------------------------------------------------------- X18
def q_avg_speed(spark, sf):
    r = view(spark, sf, "remote_files")
    secs = (F.length("file_id") * 0 + (F.substring("file_id", 9, 3).cast("int") % 50) / 10.0)
    return r.select("file_id", F.round(avg_speed_mb_s("size", secs), 6).alias("mb_per_s"))


register("avg_speed", with_views("""SELECT file_id, round((cast(size AS DOUBLE) / 1048576.0)
  / greatest((cast(substr(file_id, 9, 3) AS INTEGER) % 50) / 10.0, 0.001), 6) AS mb_per_s
FROM remote_files""", "remote_files"))(q_avg_speed)


# ----------------------------------------------------------------- S10
_SNAP = """SELECT event_id, '{"' || run_id || '":{"run_id":"' || run_id || '","stage":"' || stage
  || '","overall_percent":' || cast(bytes_done % 100 AS string)
  || ',"download":{"bytes_done":' || cast(bytes_done AS string) || ',"bytes_total":'
  || cast(bytes_total AS string) || ',"weight":1,"percent":' || cast(bytes_done % 100 AS string) || '},'
  || '"extraction":{"bytes_done":0,"bytes_total":0,"weight":3,"percent":0},'
  || '"compression":{"bytes_done":0,"bytes_total":0,"weight":3,"percent":0}}}' AS json
FROM transfer_events"""


def q_progress_snapshot(spark, sf):
    view(spark, sf, "transfer_events").createOrReplaceTempView("transfer_events")
    snap = spark.sql(_SNAP)
    p = parse_progress(snap)
    return p.select("run_key", "run_id", "stage", F.round("overall_percent", 6).alias("overall_percent"),
                    "download_bytes_done", "download_bytes_total", F.round("download_weight", 6).alias("download_weight"),
                    F.round("extraction_weight", 6).alias("extraction_weight"))


register("progress_snapshot", with_views(f"""s AS ({_SNAP})
SELECT run_id AS run_key, run_id, stage, round(cast(bytes_done % 100 AS DOUBLE), 6) AS overall_percent,
  bytes_done AS download_bytes_done, bytes_total AS download_bytes_total,
  cast(1.0 AS DOUBLE) AS download_weight, cast(3.0 AS DOUBLE) AS extraction_weight
FROM transfer_events""", "transfer_events"))(q_progress_snapshot)


# ----------------------------------------------------------------- K6 (rows only: random nonce)
_EXPORT_KEY = "00112233445566778899aabbccddeeff00112233445566778899aabbccddeeff"


def q_progress_export(spark, sf):
    l = _latest(spark, sf)
    z = F.struct(F.lit(0).cast("long").alias("bytes_done"), F.lit(0).cast("long").alias("bytes_total"),
                 F.lit(0.0).alias("weight"), F.lit(0.0).alias("percent"))
    prog = l.select("run_id", "stage",
                    stage_percent("bytes_done", "bytes_total", F.col("stage") == "completed").alias("overall_percent"),
                    F.struct("bytes_done", "bytes_total", F.lit(1.0).alias("weight"),
                             stage_percent("bytes_done", "bytes_total").alias("percent")).alias("download"),
                    z.alias("extraction"), z.alias("compression"))
    return export_progress(prog, key_hex=_EXPORT_KEY)


register("progress_export")(q_progress_export)


def q_progress_export_roundtrip(spark, sf):
    """K6 -> decrypt -> S10: the exported, encrypted progress of every run
    decrypts and parses back to the latest state."""
    enc = q_progress_export(spark, sf)
    key = F.unhex(F.lit(_EXPORT_KEY))
    plain = enc.select(F.aes_decrypt(F.concat(F.unbase64("nonce"), F.unbase64("ciphertext")), key, F.lit("GCM"))
                       .cast("string").alias("json"))
    back = parse_progress(plain)
    return back.select("run_key", "run_id", "stage", F.round("overall_percent", 6).alias("overall_percent"),
                       "download_bytes_done", F.round("download_percent", 6).alias("download_percent"))


register("progress_export_roundtrip", with_views(f"""{_LATEST_SQL}
SELECT run_id AS run_key, run_id, stage, round({_A7}, 6) AS overall_percent, bytes_done AS download_bytes_done,
  round(CASE WHEN bytes_total > 0 THEN least(bytes_done / bytes_total * 100.0, 100.0) ELSE 0.0 END, 6)
    AS download_percent
FROM latest""", "transfer_events"))(q_progress_export_roundtrip)
