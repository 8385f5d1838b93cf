"""Transfer-planning queries: G2, J2, J3, J4, J5, J9, A6, S7, S9, O3, W4,
X7, X13."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..functions.columns import file_stamp, header_stamp, output_paths, resolve_url_pair, target_name
from ..operators.progress import sort_by_path
from ..operators.runs import process_runs
from ..plans.resume import (backoff_cost, chunk_plan, chunk_retries, explode_uris, file_tasks, ftp_decision, has_fastq,
                            locate_runs, pending_chunks, resume_bytes, resume_decision)
from ..session import scratch_path
from ..sources.locators import extract_locators
from ..sources.state import parse_chunk_state
from ..sources.text import read_numbered_lines
from . import register
from .duck import processed_cte

CHUNK = 10_000
ATTEMPT_ORDER = ["p", "q", "n", "x", "dsc", "tx", "ok", "kind", "progressed"]
_ORDER_SQL = ", ".join(ATTEMPT_ORDER)

_PLAN_SQL = f"""plan AS (
  SELECT file_id, i AS chunk_id, i * {CHUNK} AS start, least((i + 1) * {CHUNK} - 1, size - 1) AS "end"
  FROM (SELECT file_id, size, unnest(range(0, cast((size - 1) // {CHUNK} + 1 AS BIGINT))) AS i
        FROM remote_files WHERE size > 0) t)"""


# ----------------------------------------------------------------- G2
def _plan(spark, sf):
    return chunk_plan(view(spark, sf, "remote_files"), CHUNK)


def q_chunk_plan(spark, sf):
    return _plan(spark, sf)


register("chunk_plan", with_views(f"""{_PLAN_SQL}
SELECT file_id, chunk_id, start, "end" FROM plan""", "remote_files"))(q_chunk_plan)


# ----------------------------------------------------------------- J4
def q_pending_chunks(spark, sf):
    return pending_chunks(_plan(spark, sf), view(spark, sf, "chunk_state"))


register("pending_chunks", with_views(f"""{_PLAN_SQL}
SELECT p.file_id, p.chunk_id, p.start, p."end" FROM plan p
WHERE NOT EXISTS (SELECT 1 FROM chunk_state s WHERE s.file_id = p.file_id AND s.chunk_id = p.chunk_id)""",
                                      "remote_files", "chunk_state"))(q_pending_chunks)


# ----------------------------------------------------------------- A6
def q_resume_bytes(spark, sf):
    return resume_bytes(view(spark, sf, "remote_files"), view(spark, sf, "chunk_state"), CHUNK)


register("resume_bytes", with_views(f"""ids AS (SELECT DISTINCT file_id, chunk_id FROM chunk_state)
SELECT r.file_id, r.size, least(cast(coalesce(sum(greatest(0, least((i.chunk_id + 1) * {CHUNK}, r.size)
    - i.chunk_id * {CHUNK})), 0) AS BIGINT), r.size) AS bytes_held
FROM remote_files r LEFT JOIN ids i ON i.file_id = r.file_id GROUP BY r.file_id, r.size""",
                                    "remote_files", "chunk_state"))(q_resume_bytes)


# ----------------------------------------------------------------- J2
def q_resume_decision(spark, sf):
    return resume_decision(view(spark, sf, "remote_files"), view(spark, sf, "local_files"),
                           view(spark, sf, "chunk_state"))


register("resume_decision", with_views("""st AS (SELECT DISTINCT file_id FROM chunk_state)
SELECT r.file_id, r.size, l.local_size, st.file_id IS NOT NULL AS has_state,
  CASE WHEN l.local_size IS NULL THEN 'NEW' WHEN l.local_size <> r.size THEN 'RESTART'
       WHEN st.file_id IS NOT NULL THEN 'RESUME' ELSE 'VERIFY' END AS decision,
  l.local_size IS NULL AND st.file_id IS NOT NULL AS stale_state
FROM remote_files r LEFT JOIN local_files l ON l.file_id = r.file_id
LEFT JOIN st ON st.file_id = r.file_id""", "remote_files", "local_files", "chunk_state"))(q_resume_decision)


# ----------------------------------------------------------------- J3
def q_ftp_decision(spark, sf):
    tasks = file_tasks(process_runs(view(spark, sf, "run_report")))
    d = ftp_decision(tasks, view(spark, sf, "ftp_local"))
    return d.select("run_accession", F.col("mate").cast("bigint").alias("mate"), "filename",
                    F.col("total_size").cast("bigint").alias("total_size"), "local_size", "decision")


register("ftp_decision", with_views(f"""{processed_cte()},
tasks AS (
  SELECT run_accession, 1 AS mate, fastq_ftp_1_name AS filename, fastq_md5_1 AS md5, fastq_bytes_1 AS total_size
  FROM processed
  UNION ALL
  SELECT run_accession, 2, fastq_ftp_2_name, fastq_md5_2, fastq_bytes_2 FROM processed
  WHERE fastq_ftp_2_url IS NOT NULL AND fastq_md5_2 IS NOT NULL AND fastq_ftp_2_name IS NOT NULL
    AND fastq_bytes_2 IS NOT NULL)
SELECT t.run_accession, cast(t.mate AS BIGINT) AS mate, t.filename, cast(t.total_size AS BIGINT) AS total_size,
  l.local_size,
  CASE WHEN l.local_size = t.total_size AND t.total_size > 0 AND coalesce(l.local_md5 = t.md5, false) THEN 'SKIP'
       WHEN l.local_size = t.total_size AND t.total_size > 0 THEN 'MISMATCH'
       WHEN l.local_size > 0 THEN 'RESUME' ELSE 'NEW' END AS decision
FROM tasks t LEFT JOIN ftp_local l ON l.filename = t.filename""", "run_report", "ftp_local"))(q_ftp_decision)


# ----------------------------------------------------------------- S7
def _locators(spark, sf):
    return extract_locators(view(spark, sf, "sra_xml"))


def q_sra_locator(spark, sf):
    return _locators(spark, sf).select("run_id", "s3_uri", "http_url", "md5",
                                       F.col("size").cast("bigint").alias("size"))


_LOC_SQL = """loc AS (SELECT 'SRR' || lpad(cast(s_suppkey AS string), 8, '0') AS run_id,
    CASE WHEN s_suppkey % 2 = 1 THEN 's3://odp/sra/' || cast(s_suppkey AS string) END AS s3_uri,
    CASE WHEN s_suppkey % 2 = 1 THEN 'https://odp.s3.amazonaws.com/sra/' || cast(s_suppkey AS string) END AS http_url,
    CASE WHEN s_suppkey % 2 = 1 THEN md5(s_name) END AS md5,
    CASE WHEN s_suppkey % 2 = 1 THEN cast(s_suppkey * 1000 AS BIGINT) END AS size
  FROM supplier)"""

register("sra_locator", f"""WITH {_LOC_SQL}
SELECT run_id, s3_uri, http_url, md5, size FROM loc""")(q_sra_locator)


# ----------------------------------------------------------------- J5
def q_locate_runs(spark, sf):
    runs = view(spark, sf, "run_report").select(F.col("run_accession").alias("run_id"))
    loc = _locators(spark, sf).where(F.col("s3_uri").isNotNull()).select("run_id", "s3_uri")
    return locate_runs(runs, loc).select("run_id", "s3_uri", "status", "error")


register("locate_runs", with_views(f"""{_LOC_SQL}
SELECT r.run_accession AS run_id, l.s3_uri,
  CASE WHEN l.s3_uri IS NULL THEN 'failed' ELSE 'located' END AS status,
  CASE WHEN l.s3_uri IS NULL THEN 'No S3 URI for ' || r.run_accession END AS error
FROM run_report r LEFT JOIN (SELECT * FROM loc WHERE s3_uri IS NOT NULL) l ON l.run_id = r.run_accession""",
                                   "run_report"))(q_locate_runs)


# ----------------------------------------------------------------- X7
def q_url_resolve(spark, sf):
    loc = view(spark, sf, "object_listing")
    u = loc.select("key", F.when(F.length("key") % 2 == 0,
                                 F.concat(F.lit("s3://"), F.col("bucket"), F.lit("/"), F.col("key")))
                   .otherwise(F.concat(F.lit("https://"), F.col("bucket"), F.lit(".s3.amazonaws.com/"), F.col("key")))
                   .alias("url"))
    u = u.union(loc.select("key", F.concat(F.lit("ftp://"), F.col("key")).alias("url")))
    p = resolve_url_pair("url")
    return u.select("key", "url", p["s3_uri"].alias("s3_uri"), p["http_url"].alias("http_url"))


register("url_resolve", with_views("""u AS (
  SELECT key, CASE WHEN length(key) % 2 = 0 THEN 's3://' || bucket || '/' || key
    ELSE 'https://' || bucket || '.s3.amazonaws.com/' || key END AS url FROM object_listing
  UNION ALL SELECT key, 'ftp://' || key FROM object_listing)
SELECT key, url,
  CASE WHEN starts_with(url, 's3://') AND contains(substr(url, 6), '/') THEN url
       WHEN regexp_matches(url, '^https://.*?[.]s3[.]amazonaws[.]com/')
         THEN 's3://' || regexp_extract(url, '^https://(.*?)[.]s3[.]amazonaws[.]com/(.*)$', 1) || '/'
           || regexp_extract(url, '^https://(.*?)[.]s3[.]amazonaws[.]com/(.*)$', 2) END AS s3_uri,
  CASE WHEN starts_with(url, 's3://') AND contains(substr(url, 6), '/')
         THEN 'https://' || split_part(substr(url, 6), '/', 1) || '.s3.amazonaws.com/'
           || substr(url, 6 + strpos(substr(url, 6), '/'))
       WHEN regexp_matches(url, '^https://.*?[.]s3[.]amazonaws[.]com/') THEN url END AS http_url
FROM u""", "object_listing"))(q_url_resolve)


# ----------------------------------------------------------------- X13
def q_target_name(spark, sf):
    loc = _locators(spark, sf)
    u = loc.select("run_id", F.coalesce(F.col("s3_uri"), F.concat(F.lit("s3://odp/sra/"))).alias("s3_uri"))
    return u.select("run_id", "s3_uri", target_name("s3_uri", "run_id").alias("target"))


register("target_name", f"""WITH {_LOC_SQL}
SELECT run_id, coalesce(s3_uri, 's3://odp/sra/') AS s3_uri,
  coalesce(nullif(regexp_extract(coalesce(s3_uri, 's3://odp/sra/'), '[^/]*$'), ''), run_id) AS target
FROM loc""")(q_target_name)


# ----------------------------------------------------------------- S9
def q_chunk_state(spark, sf):
    return parse_chunk_state(view(spark, sf, "chunk_state_json"))


register("chunk_state", with_views("""p AS (SELECT file_id,
    CASE WHEN json_valid(state_json) THEN TRY_CAST(json_extract(state_json, '$.downloaded_chunks') AS BIGINT[]) END AS ids
  FROM chunk_state_json)
SELECT file_id, unnest(list_distinct(ids)) AS chunk_id FROM p
WHERE ids IS NOT NULL AND len(list_filter(ids, lambda x: x IS NULL OR x < 0)) = 0""",
                                   "chunk_state_json"))(q_chunk_state)


# ----------------------------------------------------------------- J9
def q_has_fastq(spark, sf):
    runs = view(spark, sf, "run_report").select(F.col("run_accession").alias("run_id"))
    return has_fastq(runs, view(spark, sf, "conversion_outputs")).select("run_id", "has_fastq")


register("has_fastq", with_views("""SELECT r.run_accession AS run_id, EXISTS (
    SELECT 1 FROM conversion_outputs c WHERE c.length > 0
      AND (c.filename = r.run_accession || '_1.fastq' OR c.filename = r.run_accession || '.fastq')) AS has_fastq
FROM run_report r""", "run_report", "conversion_outputs"))(q_has_fastq)


# ----------------------------------------------------------------- W4
def q_chunk_retries(spark, sf):
    a = view(spark, sf, "chunk_attempts")
    r = chunk_retries(a, order=ATTEMPT_ORDER)
    return r.select("file_id", "chunk_id", "p", "q", "x", "ok", F.col("failure_no").cast("bigint").alias("failure_no"),
                    "action")


register("chunk_retries", with_views(f"""SELECT file_id, chunk_id, p, q, x, ok,
  cast(sum(CASE WHEN NOT ok THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, chunk_id ORDER BY {_ORDER_SQL}
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS failure_no,
  CASE WHEN ok THEN 'done' WHEN sum(CASE WHEN NOT ok THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, chunk_id
    ORDER BY {_ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 3 THEN 'requeue'
    ELSE 'fatal' END AS action
FROM chunk_attempts""", "chunk_attempts"))(q_chunk_retries)


# ----------------------------------------------------------------- O3
def q_backoff_cost(spark, sf):
    a = view(spark, sf, "chunk_attempts").where(~F.col("ok"))
    return backoff_cost(a, order=ATTEMPT_ORDER)


register("backoff_cost", with_views(f"""f AS (SELECT * FROM chunk_attempts WHERE NOT ok),
s AS (SELECT *, sum(CASE WHEN progressed THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, chunk_id
    ORDER BY {_ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY file_id, chunk_id, seg ORDER BY {_ORDER_SQL}) AS k FROM s),
g AS (SELECT *, CASE WHEN (kind = 'range' AND k > 10) OR (kind <> 'range' AND k > 20) THEN 1 ELSE 0 END AS gu FROM k),
d AS (SELECT *, max(gu) OVER (PARTITION BY file_id, chunk_id ORDER BY {_ORDER_SQL}
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dead FROM g)
SELECT file_id, chunk_id, cast(count(*) AS BIGINT) AS failures,
  cast(coalesce(sum(CASE WHEN dead = 0 THEN CASE WHEN kind = 'range' THEN k ELSE least(30, 1 << least(k, 5)) END END), 0)
    AS BIGINT) AS sleep_s,
  max(dead) = 1 AS gave_up
FROM d GROUP BY file_id, chunk_id""", "chunk_attempts"))(q_backoff_cost)


# ----------------------------------------------------------------- G3
def q_explode_uris(spark, sf):
    u = view(spark, sf, "run_report").select("run_accession", F.when(F.col("fastq_ftp") != "", F.split("fastq_ftp", ";")).alias("uris"))
    return explode_uris(u).select("run_accession", F.col("pos").cast("bigint").alias("pos"), "uri")


register("explode_uris", with_views("""u AS (SELECT run_accession, CASE WHEN fastq_ftp <> '' THEN string_split(fastq_ftp, ';') END AS uris
  FROM run_report)
SELECT run_accession, cast(i AS BIGINT) AS pos, uris[i + 1] AS uri
FROM (SELECT run_accession, uris, unnest(range(len(uris))) AS i FROM u)
UNION ALL SELECT run_accession, NULL, NULL FROM u WHERE uris IS NULL""", "run_report"))(q_explode_uris)


# ----------------------------------------------------------------- X16, X19
def q_output_paths(spark, sf):
    r = view(spark, sf, "run_report").select("run_accession", output_paths("study_accession").alias("p"))
    return r.select("run_accession", "p.*")


register("output_paths", with_views("""SELECT run_accession, study_accession || '_metadata' AS folder,
  'ena_metadata_' || study_accession || '.tsv' AS report, 'R1_fastq_md5_' || study_accession || '.tsv' AS mate_1,
  'R2_fastq_md5_' || study_accession || '.tsv' AS mate_2 FROM run_report""", "run_report"))(q_output_paths)


def q_clock_stamps(spark, sf):
    e = view(spark, sf, "transfer_events")
    return e.select("event_id", file_stamp("ts").alias("file_stamp"), header_stamp("ts").alias("header_stamp"))


register("clock_stamps", with_views("""SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS file_stamp,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS header_stamp FROM transfer_events""", "transfer_events"))(q_clock_stamps)


# ----------------------------------------------------------------- O1
def q_sort_by_path(spark, sf):
    """The sorted paths written in order and read back with their file order: each
    path with the number of paths before it."""
    out = scratch_path(spark, f"sorted_{uuid.uuid4().hex}")
    sort_by_path(view(spark, sf, "inventory_paths").select("path")).write.text(out)
    lines = read_numbered_lines(spark, out)
    sizes = lines.groupBy("file").agg(F.max("line_no").alias("n"))
    # part files are in order of their names; one row per part
    before = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    return lines.join(before, "file").select(F.col("value").alias("path"), (F.col("b") + F.col("line_no")).cast("bigint").alias("pos"))


register("sort_by_path", with_views("""SELECT path, cast(row_number() OVER (ORDER BY path) AS BIGINT) AS pos
FROM inventory_paths""", "inventory_paths"))(q_sort_by_path)
