"""Checksum queries: S5, S6, F7, X15, J1, A1, J8, J10, K3."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fixtures import table, view, with_views
from ..operators.checksum import check_integrity, content_md5, file_md5, manifest_rows, reconcile, verify_manifest, \
    verify_manifest_at, verify_summary
from ..operators.filters import is_md5_log
from ..sources.manifest import filter_inventory, parse_manifest_lines
from . import register

MANIFEST_NAME = "md5.txt"
MANIFEST_PATH = "/data/src1/doc_1.txt"
_LOG = "(starts_with({0}, 'transfer_md5') AND ends_with({0}, '.log'))"


# ----------------------------------------------------------------- S5
def q_manifest_parse(spark, sf):
    lines = view(spark, sf, "manifest_text")
    return parse_manifest_lines(lines, value="line").select("file", "line_no", "md5", "filename", "error")


register("manifest_parse", with_views("""p AS (
  SELECT file, line_no, t, strpos(t, '  ') AS pos FROM (SELECT file, line_no, trim(line) AS t FROM manifest_text) a
  WHERE t <> '' AND NOT starts_with(t, '#')),
q AS (SELECT file, line_no, pos,
    CASE WHEN pos > 0 THEN lower(substr(t, 1, pos - 1)) END AS md5,
    CASE WHEN pos > 0 THEN substr(t, pos + 2) END AS filename FROM p),
r AS (SELECT file, line_no, md5, filename,
    CASE WHEN pos = 0 THEN 'Invalid line ' || cast(line_no AS VARCHAR) || ' in ' || file
           || ': expected ''<md5>  <filename>'''
         WHEN NOT regexp_full_match(md5, '[0-9a-f]{32}') THEN 'Invalid MD5 on line ' || cast(line_no AS VARCHAR)
           || ' in ' || file || ': ' || md5 END AS error FROM q)
SELECT file, line_no, CASE WHEN error IS NULL THEN md5 END AS md5,
  CASE WHEN error IS NULL THEN filename END AS filename, error FROM r""", "manifest_text"))(q_manifest_parse)


# ----------------------------------------------------------------- J1
def _verified(spark, sf):
    entries = view(spark, sf, "manifest_entries")
    actual = view(spark, sf, "inventory").select("filename", "actual_md5")
    return verify_manifest(entries, actual, manifest_name=MANIFEST_NAME)


def q_manifest_verify(spark, sf):
    v = _verified(spark, sf)
    return v.select("filename", "expected_md5", "actual_md5", F.col("copies").cast("bigint").alias("copies"),
                    "status")


_J1 = f"""a AS (SELECT filename, count(*) AS copies, min(actual_md5) AS lo, max(actual_md5) AS hi
  FROM inventory GROUP BY filename),
v AS (SELECT e.filename, lower(e.md5) AS expected_md5,
    CASE WHEN a.copies = 1 THEN a.lo END AS actual_md5, cast(coalesce(a.copies, 0) AS BIGINT) AS copies,
    CASE WHEN a.copies IS NULL THEN 'MISSING' WHEN a.lo = lower(e.md5) AND a.hi = lower(e.md5) THEN 'OK'
         WHEN a.copies > 1 THEN 'AMBIGUOUS' ELSE 'MISMATCH' END AS status
  FROM manifest_entries e LEFT JOIN a ON a.filename = e.filename
  WHERE NOT {_LOG.format('e.filename')} AND e.filename <> '{MANIFEST_NAME}')"""

register("manifest_verify", with_views(f"""{_J1}
SELECT filename, expected_md5, actual_md5, copies, status FROM v""",
                                       "manifest_entries", "inventory"))(q_manifest_verify)


# ----------------------------------------------------------------- A1
def q_verify_summary(spark, sf):
    s = verify_summary(_verified(spark, sf))
    return s.select(F.col("passed").cast("bigint").alias("passed"), F.col("failed").cast("bigint").alias("failed"))


register("verify_summary", with_views(f"""{_J1}
SELECT cast(count_if(status = 'OK') AS BIGINT) AS passed, cast(count_if(status <> 'OK') AS BIGINT) AS failed
FROM v""", "manifest_entries", "inventory"))(q_verify_summary)


# ----------------------------------------------------------------- F7
def q_artifact_skip(spark, sf):
    e = view(spark, sf, "manifest_entries")
    return e.select("filename", (is_md5_log("filename") | (F.col("filename") == MANIFEST_NAME)).alias("is_artifact"))


register("artifact_skip", with_views(f"""SELECT filename,
  {_LOG.format('filename')} OR filename = '{MANIFEST_NAME}' AS is_artifact
FROM manifest_entries""", "manifest_entries"))(q_artifact_skip)


# ----------------------------------------------------------------- S6
def q_inventory_filter(spark, sf):
    p = view(spark, sf, "inventory_paths")
    return filter_inventory(p, "/data").select("path", "rel_path", "length")


register("inventory_filter", with_views(f"""SELECT path, rel_path, length FROM (
  SELECT path, substr(path, 7) AS rel_path, length, regexp_extract(path, '[^/]*$') AS name
  FROM inventory_paths WHERE starts_with(path, '/data/')) t
WHERE NOT regexp_matches(rel_path, '(^|/)[.]') AND NOT {_LOG.format('name')}""",
                                        "inventory_paths"))(q_inventory_filter)


# ----------------------------------------------------------------- X15
def q_content_md5(spark, sf):
    docs = table(spark, sf, "documents")
    return content_md5(docs, "text").select("doc_id", "actual_md5")


register("content_md5", "SELECT doc_id, md5(text) AS actual_md5 FROM documents")(q_content_md5)


# ----------------------------------------------------------------- J8
def q_integrity_check(spark, sf):
    r = view(spark, sf, "remote_files")
    l = view(spark, sf, "local_files")
    return check_integrity(r, l)


register("integrity_check", with_views("""SELECT r.file_id,
  CASE WHEN r.md5 IS NOT NULL THEN 'md5' ELSE 'size' END AS method,
  CASE WHEN l.local_size IS NULL THEN false
       WHEN r.md5 IS NOT NULL THEN coalesce(l.local_md5 = r.md5, false)
       ELSE l.local_size = r.size END AS valid
FROM remote_files r LEFT JOIN local_files l ON l.file_id = r.file_id""",
                                       "remote_files", "local_files"))(q_integrity_check)


# ----------------------------------------------------------------- J10
def q_reconcile(spark, sf):
    local = view(spark, sf, "inventory").select("filename", F.col("actual_md5").alias("md5"))
    archive = view(spark, sf, "manifest_entries")
    return reconcile(local, archive).select("filename", "local_md5", "archive_md5", "status")


register("reconcile", with_views("""SELECT coalesce(l.filename, a.filename) AS filename, l.local_md5, a.archive_md5,
  CASE WHEN l.local_md5 IS NULL THEN 'archive_only' WHEN a.archive_md5 IS NULL THEN 'local_only'
       WHEN l.n > 1 OR a.n > 1 THEN 'conflict'
       WHEN l.local_md5 = a.archive_md5 THEN 'matched' ELSE 'differs' END AS status
FROM (SELECT filename, min(lower(actual_md5)) AS local_md5, count(DISTINCT lower(actual_md5)) AS n
  FROM inventory GROUP BY filename) l
FULL OUTER JOIN (SELECT filename, min(lower(md5)) AS archive_md5, count(DISTINCT lower(md5)) AS n
  FROM manifest_entries GROUP BY filename) a
  ON l.filename = a.filename""", "inventory", "manifest_entries"))(q_reconcile)


# ----------------------------------------------------------------- K3
def q_manifest_generate(spark, sf):
    p = view(spark, sf, "inventory_paths")
    return manifest_rows(p, manifest_path=MANIFEST_PATH).select("path", "line")


register("manifest_generate", with_views(f"""SELECT path, actual_md5 || '  ' || regexp_extract(path, '[^/]*$') AS line
FROM inventory_paths
WHERE NOT {_LOG.format("regexp_extract(path, '[^/]*$')")} AND path <> '{MANIFEST_PATH}'""",
                                         "inventory_paths"))(q_manifest_generate)


# ----------------------------------------------------------------- J1 by path
# Entries name files below the root: every 7th with a "./", every 11th that is
# not there, every 5th with another md5; the logs lie in their sources' folders.
_AT = """at_root AS (SELECT CASE WHEN {id} % 7 = 0 THEN './' ELSE '' END || substr(path, 7)
    || CASE WHEN {id} % 11 = 0 THEN '.gone' ELSE '' END AS filename,
  CASE WHEN {id} % 5 = 0 THEN upper(md5(path)) ELSE upper(actual_md5) END AS md5 FROM inventory_paths)"""
_PATH_ID = "cast(regexp_extract(path, '_([0-9]+)[.]', 1) AS bigint)"


def q_manifest_verify_root(spark, sf):
    view(spark, sf, "inventory_paths").createOrReplaceTempView("inventory_paths")
    entries = spark.sql("WITH " + _AT.format(id=_PATH_ID) + " SELECT * FROM at_root")
    return verify_manifest_at(entries, view(spark, sf, "inventory_paths"), "/data/", MANIFEST_PATH)


register("manifest_verify_root", with_views(f"""{_AT.format(id=_PATH_ID)}
SELECT e.filename, '/data/' || replace(e.filename, './', '') AS path, lower(e.md5) AS expected_md5, p.actual_md5,
  CASE WHEN p.path IS NULL THEN 'MISSING' WHEN p.actual_md5 = lower(e.md5) THEN 'OK' ELSE 'MISMATCH' END AS status
FROM at_root e LEFT JOIN inventory_paths p ON p.path = '/data/' || replace(e.filename, './', '')
WHERE NOT {_LOG.format("regexp_extract(e.filename, '[^/]*$')")}
  AND '/data/' || replace(e.filename, './', '') <> '{MANIFEST_PATH}'""", "inventory_paths"))(q_manifest_verify_root)


# ----------------------------------------------------------------- X15 over files
def q_file_md5(spark, sf):
    """The documents written as text, one folder per source, then hashed by path:
    every file once in the JVM and once by streaming reads, which must agree."""
    from ..session import scratch_path
    out = scratch_path(spark, f"file-md5-{uuid.uuid4().hex}")
    docs = table(spark, sf, "documents")
    (docs.select("source", F.regexp_replace("text", "\n", " ").alias("line")).repartitionByRange("source", "line")
     .sortWithinPartitions("source", "line").write.partitionBy("source").text(out))
    inline, streamed = file_md5(spark, out), file_md5(spark, out, 0)
    both = inline.withColumnRenamed("actual_md5", "inline_md5").join(streamed.drop("length"), "path")
    source = F.regexp_extract("path", "source=([^/]*)/", 1)
    return both.groupBy(source.alias("source")).agg(
        F.sum("length").alias("bytes"), (F.count_if(F.col("inline_md5") != F.col("actual_md5"))).alias("disagree"))


register("file_md5", """SELECT source, cast(sum(octet_length(encode(replace(text, chr(10), ' '))) + 1) AS BIGINT) AS bytes,
  cast(0 AS BIGINT) AS disagree FROM documents GROUP BY source""")(q_file_md5)
