"""Upload, sink and source round-trip queries: F8, X11, X12, K5, K1+S1,
S2+U1, K4, K7."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fixtures import register_tables, table, view, with_views
from ..functions.columns import basename, file_type, upload_key
from ..operators.catalog import failed_volumes, volume_attempts
from ..operators.filters import java_regex, lint_catalog, region_warning, upload_candidates
from ..operators.upload import submission_template
from ..schemas import SUBMISSION_COLUMNS
from ..session import scratch_path
from ..sinks.tables import failed_volume_lines
from ..sinks.writers import write_gzip_text, write_run_report
from ..sources.catalog import parse_catalogs
from ..sources.listing import clean_listing
from ..sources.runs import read_accession_reports, read_run_report, union_run_reports
from . import register

BUCKET = "my-bucket"
PREFIX = "uploads//"
STAMP = "2026-07-17 13:32:27"


def _uploads(spark, sf):
    return view(spark, sf, "upload_files")


# ----------------------------------------------------------------- F8
def q_upload_candidates(spark, sf):
    return upload_candidates(_uploads(spark, sf)).select("path", "length", "accepted", "reason")


register("upload_candidates", with_views("""SELECT path, length, length > 0 AS accepted,
  CASE WHEN length IS NULL THEN 'missing' WHEN length <= 0 THEN 'empty' END AS reason
FROM upload_files""", "upload_files"))(q_upload_candidates)


# ----------------------------------------------------------------- X11
def q_file_type(spark, sf):
    u = _uploads(spark, sf)
    return u.select("path", file_type(basename("path")).alias("filetype"))


register("file_type", with_views("""SELECT path, CASE
  WHEN ends_with(path, '.fastq.gz') OR ends_with(path, '.fq.gz') THEN 'fastq' WHEN ends_with(path, '.bam') THEN 'bam'
  WHEN ends_with(path, '.cram') THEN 'cram' WHEN ends_with(path, '.vcf') OR ends_with(path, '.vcf.gz') THEN 'vcf'
  ELSE 'fastq' END AS filetype FROM upload_files""", "upload_files"))(q_file_type)


# ----------------------------------------------------------------- X12
_PFX = "CASE length % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'runs/' ELSE 'runs//x//' END"


def q_upload_keys(spark, sf):
    u = _uploads(spark, sf).withColumn("prefix", F.expr(_PFX))
    return u.select("path", "prefix", upload_key("prefix", basename("path")).alias("key"))


register("upload_keys", with_views(f"""SELECT path, prefix,
  CASE WHEN prefix IS NULL THEN regexp_extract(path, '[^/]*$')
       ELSE rtrim(prefix, '/') || '/' || regexp_extract(path, '[^/]*$') END AS key
FROM (SELECT path, {_PFX} AS prefix FROM upload_files) u""", "upload_files"))(q_upload_keys)


# ----------------------------------------------------------------- K5
def q_submission_template(spark, sf):
    return submission_template(_uploads(spark, sf), BUCKET, PREFIX)


_K5_COLS = ", ".join(
    {"filename": "regexp_extract(path, '[^/]*$') AS filename",
     "filetype": """CASE WHEN ends_with(path, '.fastq.gz') OR ends_with(path, '.fq.gz') THEN 'fastq'
       WHEN ends_with(path, '.bam') THEN 'bam' WHEN ends_with(path, '.cram') THEN 'cram'
       WHEN ends_with(path, '.vcf') OR ends_with(path, '.vcf.gz') THEN 'vcf' ELSE 'fastq' END AS filetype""",
     "s3_path": f"'s3://{BUCKET}/' || rtrim('{PREFIX}', '/') || '/' || regexp_extract(path, '[^/]*$') AS s3_path"
     }.get(c, f"'' AS {c}") for c in SUBMISSION_COLUMNS)

register("submission_template", with_views(f"""SELECT {_K5_COLS} FROM upload_files WHERE length > 0""",
                                           "upload_files"))(q_submission_template)


# ----------------------------------------------------------------- K1 -> S1
def q_run_report_roundtrip(spark, sf):
    runs = view(spark, sf, "run_report")
    out = scratch_path(spark, f"run_report_{uuid.uuid4().hex}")
    path = write_run_report(runs, out, accession="PRJ1")
    back = read_run_report(spark, path)
    return back.select("run_accession", "study_accession", "sample_title", "library_layout", "fastq_ftp",
                       "fastq_md5", "fastq_bytes", "scientific_name")


register("run_report_roundtrip", with_views("""SELECT run_accession, study_accession, coalesce(sample_title, '')
  AS sample_title, nullif(library_layout, '') AS library_layout, coalesce(fastq_ftp, '') AS fastq_ftp,
  coalesce(fastq_md5, '') AS fastq_md5, coalesce(fastq_bytes, '') AS fastq_bytes,
  cast(NULL AS VARCHAR) AS scientific_name
FROM run_report""", "run_report"))(q_run_report_roundtrip)


# ----------------------------------------------------------------- S1
def q_run_report_scan(spark, sf):
    runs = view(spark, sf, "run_report")
    root = scratch_path(spark, f"reports_{uuid.uuid4().hex}")
    opts = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "emptyValue": ""}
    # two landings with different column orders and subsets in one folder
    runs.where(F.col("library_layout") == "PAIRED").select(
        "fastq_md5", "run_accession", "fastq_ftp", "sample_title", "study_accession", "fastq_bytes") \
        .write.options(**opts).csv(root + "/a")
    runs.where(F.col("library_layout") != "PAIRED").select(
        "run_accession", "study_accession", "library_layout", "fastq_ftp", "fastq_md5") \
        .write.options(**opts).csv(root + "/b")
    back = read_run_report(spark, root, recursive=True)
    return back.select("run_accession", "study_accession", "sample_title", "library_layout", "fastq_ftp",
                       "fastq_md5", "fastq_bytes")


register("run_report_scan", with_views("""SELECT run_accession, study_accession, coalesce(sample_title, '')
  AS sample_title, NULL AS library_layout, fastq_ftp, fastq_md5, fastq_bytes
FROM run_report WHERE library_layout = 'PAIRED'
UNION ALL
SELECT run_accession, study_accession, '', library_layout, fastq_ftp, fastq_md5, ''
FROM run_report WHERE library_layout <> 'PAIRED'""", "run_report"))(q_run_report_scan)


# ----------------------------------------------------------------- S2 + U1
def q_accession_union(spark, sf):
    runs = view(spark, sf, "run_report")
    root = scratch_path(spark, f"accessions_{uuid.uuid4().hex}")
    paired = runs.where(F.col("library_layout") == "PAIRED")
    single = runs.where(F.col("library_layout") != "PAIRED").drop("sample_title")
    write_run_report(paired, root, accession="PRJPAIRED")
    write_run_report(single, root, accession="PRJSINGLE")
    landed = read_accession_reports(spark, root)
    # a second source without the accession column (U1 fills it with null)
    extra = runs.where(F.col("fastq_ftp") == "").select("run_accession", "study_accession")
    u = union_run_reports(landed, extra)
    return u.select("accession", "run_accession", "study_accession", "sample_title", "library_layout")


register("accession_union", with_views("""SELECT CASE WHEN library_layout = 'PAIRED' THEN 'PRJPAIRED'
    ELSE 'PRJSINGLE' END AS accession, run_accession, study_accession,
  CASE WHEN library_layout = 'PAIRED' THEN coalesce(sample_title, '') ELSE '' END AS sample_title, library_layout
FROM run_report
UNION ALL
SELECT NULL, run_accession, study_accession, '', NULL FROM run_report WHERE fastq_ftp = ''""",
                                       "run_report"))(q_accession_union)


# ----------------------------------------------------------------- K4
def q_failed_volume_manifest(spark, sf):
    w5 = volume_attempts(view(spark, sf, "volume_outcomes"), max_retries=2,
                         order=("attempt", "p", "q", "x", "outcome"))
    objs = clean_listing(view(spark, sf, "object_listing"), "2026-01/")
    f = failed_volumes(w5, objs, order_col="batch")
    lines = failed_volume_lines(f, STAMP, "blast-db")
    return lines.select(F.col("sort_key.volume").alias("volume"), F.col("sort_key.kind").cast("bigint").alias("kind"),
                        "line")


register("failed_volume_manifest", with_views(f"""r AS (SELECT *, row_number() OVER (PARTITION BY volume, batch,
      outcome = 'corrupted' ORDER BY attempt, p, q, x, outcome) AS rk FROM volume_outcomes),
t AS (SELECT volume, batch, outcome, row_number() OVER (PARTITION BY volume, batch
      ORDER BY attempt, p, q, x, outcome) AS n
    FROM r WHERE outcome IN ('valid', 'tool_error') OR (outcome = 'corrupted' AND rk = 3)),
w5 AS (SELECT volume, batch, CASE WHEN outcome = 'tool_error' THEN 'Volume ' || volume || ' validation command failed'
    ELSE 'Volume ' || volume || ' failed validation after 2 retries' END AS error
  FROM t WHERE n = 1 AND outcome <> 'valid'),
fv AS (SELECT volume, arg_min(error, batch) AS error FROM w5 GROUP BY volume),
f AS (SELECT fv.volume, fv.error, 's3://' || o.bucket || '/' || o.key AS uri FROM fv
  JOIN (SELECT * FROM object_listing WHERE key IS NOT NULL AND size IS NOT NULL
        AND NOT (ends_with(key, '/') AND size = 0) AND starts_with(key, '2026-01/')) o
  ON regexp_replace(regexp_extract(o.key, '[^/]*$'), '^(.+)[.][^.]*$', '\\1') = fv.volume)
SELECT '' AS volume, cast(0 AS BIGINT) AS kind, '# Failed volumes for blast-db' AS line
UNION ALL SELECT '', 1, '# Generated at {STAMP}'
UNION ALL SELECT '', 2, '# Total: ' || (SELECT cast(count(*) AS VARCHAR) FROM fv)
UNION ALL SELECT '', 3, ''
UNION ALL SELECT volume, 0, '[volume: ' || volume || ']' FROM fv
UNION ALL SELECT volume, 1, '# error: ' || error FROM fv
UNION ALL SELECT volume, 2, uri FROM f
UNION ALL SELECT volume, 3, '' FROM fv""", "volume_outcomes", "object_listing"))(q_failed_volume_manifest)


# ----------------------------------------------------------------- K7 (write gzip, read back)
def q_gzip_roundtrip(spark, sf):
    docs = table(spark, sf, "documents")
    lines = docs.select(F.col("source").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "line")) \
        .select("file", (F.col("pos") + 1).alias("line_no"), "line")
    out = scratch_path(spark, f"gzip_{uuid.uuid4().hex}")
    write_gzip_text(lines, out)
    back = spark.read.option("lineSep", "\n").text(out)
    return back.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).alias("chars"))


register("gzip_roundtrip", """SELECT source AS file, cast(count(*) AS BIGINT) AS lines,
  cast(sum(length(l)) AS BIGINT) AS chars
FROM (SELECT source, unnest(string_split(text, chr(10))) AS l FROM documents) t GROUP BY source""")(q_gzip_roundtrip)


# ----------------------------------------------------------------- F10
_ENTRIES = """entries AS (SELECT 'db_' || cast(p_partkey AS string) AS name,
  CASE p_partkey % 5 WHEN 0 THEN 'https://host/x' WHEN 1 THEN 's3://bucket' WHEN 2 THEN 's3://bucket/dir/' ELSE ' s3://bucket/dir/f ' END AS s3_url,
  CASE p_partkey % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'folder' ELSE 'table' END AS database_type,
  p_partkey % 2 = 0 AS enabled, CASE p_partkey % 7 WHEN 0 THEN 'blastdbcmd' WHEN 1 THEN 'other' END AS tool,
  CASE p_partkey % 4 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'eu-west-1' END AS region FROM part)"""


def q_catalog_lint(spark, sf):
    register_tables(spark, sf, ["part"])
    e = spark.sql(f"WITH {_ENTRIES} SELECT * FROM entries").withColumn("validate", F.struct("enabled", "tool"))
    return lint_catalog(e).select("name", F.array_join("issues", "; ").alias("issues"), region_warning("region").alias("warning"))


register("catalog_lint", f"""WITH {_ENTRIES}
SELECT name, concat_ws('; ',
    CASE WHEN NOT starts_with(trim(s3_url), 's3://') THEN 's3_url must start with s3://' END,
    CASE WHEN database_type = 'file' AND (regexp_extract(trim(s3_url), '^s3://[^/]*/(.*)$', 1) = ''
      OR ends_with(trim(s3_url), '/')) THEN 'file entry needs an object key that does not end with /' END,
    CASE WHEN enabled AND coalesce(tool, '') <> 'blastdbcmd' THEN 'validate.tool must be blastdbcmd' END,
    CASE WHEN database_type NOT IN ('file', 'folder') THEN 'type must be file or folder' END) AS issues,
  CASE WHEN region <> 'us-east-1' THEN 'bucket region is ' || region || ', not us-east-1' END AS warning
FROM entries""")(q_catalog_lint)


# ----------------------------------------------------------------- S8
# Settings documents, one per supplier: defaults, the alias of the type, a document of two entries, and bad ones.
_DOCS = """docs AS (SELECT s_suppkey AS i, s_suppkey % 7 AS k, 'db' || cast(s_suppkey AS string) AS n, 's3://b' || cast(s_nationkey AS string) || '/db/' AS u FROM supplier),
yamls AS (SELECT i, n, k, u, 'settings: 1' || chr(10) || 'public_data:' || chr(10) || '  ' || n || ':' || chr(10) || '    description: "no. ' || cast(i AS string) || '"' || chr(10)
  || CASE WHEN k = 3 THEN '' ELSE '    s3_url: ' || u || chr(10) END
  || CASE k WHEN 1 THEN '    db_type: file' || chr(10) || '    exclude: "*.md5"' WHEN 4 THEN '    database_type: tape' WHEN 6 THEN '    database_type: [folder' ELSE '    database_type: folder' END || chr(10)
  || CASE k WHEN 0 THEN '    validate: {enabled: true, tool: blastdbcmd, dbtype: nucl}' || chr(10)
       WHEN 2 THEN '    validate:' || chr(10) || '      {enabled: false, tool: x, dbtype: prot, max_retries: ' || cast(i AS string) || ', retry_delay_seconds: 1}' || chr(10)
       WHEN 5 THEN '  other:' || chr(10) || '    {s3_url: "s3://o/k", description: d, database_type: file, include: "a*"}' || chr(10) ELSE '' END AS yaml FROM docs)"""


def q_catalog_documents(spark, sf):
    register_tables(spark, sf, ["supplier"])
    docs = spark.sql(f"WITH {_DOCS} SELECT i AS doc, yaml FROM yamls")
    return parse_catalogs(docs).select(
        "doc", "name", "s3_url", "description", "database_type", "exclude", "include", "validate.enabled",
        F.col("validate.max_retries").cast("bigint").alias("max_retries"), F.col("validate.retry_delay_seconds").cast("bigint").alias("delay"), "reason")


register("catalog_documents", f"""WITH {_DOCS}
SELECT cast(i AS VARCHAR) AS doc, CASE WHEN k IN (3, 4, 6) THEN NULL ELSE n END AS name, CASE WHEN k IN (3, 4, 6) THEN NULL ELSE u END AS s3_url,
  CASE WHEN k IN (3, 4, 6) THEN NULL ELSE 'no. ' || i END AS description, CASE WHEN k IN (3, 4, 6) THEN NULL WHEN k = 1 THEN 'file' ELSE 'folder' END AS database_type,
  CASE k WHEN 1 THEN '*.md5' END AS exclude, cast(NULL AS VARCHAR) AS include, CASE k WHEN 0 THEN true WHEN 2 THEN false END AS enabled,
  cast(CASE k WHEN 0 THEN 2 WHEN 2 THEN i END AS BIGINT) AS max_retries, cast(CASE k WHEN 0 THEN 10 WHEN 2 THEN 1 END AS BIGINT) AS delay,
  CASE k WHEN 3 THEN n || ': s3_url is required' WHEN 4 THEN n || ': database_type must be folder or file, got ''tape''' WHEN 6 THEN 'bad yaml' END AS reason FROM yamls
UNION ALL SELECT cast(i AS VARCHAR), 'other', 's3://o/k', 'd', 'file', NULL, 'a*', NULL, NULL, NULL, NULL FROM yamls WHERE k = 5""")(q_catalog_documents)


# ----------------------------------------------------------------- F1, F3: patterns of both dialects
# (dialect, pattern, the same in DuckDB's own dialect, its options)
_PATTERNS = [
    ("tool", r"^[[:upper:]][[:alpha:]]+ ", r"^[A-Z][A-Za-z]+ ", "c"), ("tool", r"[*+]", r"[*+]", "c"), ("tool", r"^\w+ \w+", r"^[\pL\pM\pN_]+ [\pL\pM\pN_]+", "c"),
    ("tool", r"[a-z--aeiou]{4}", r"[b-df-hj-np-tv-z]{4}", "c"), ("tool", r"(?P<x>th)+e", r"(th)+e", "c"), ("tool", r"a*+b", r"(a*)+b", "c"),
    ("tool", r"\\1|\$\$", r"\\1|\$\$", "c"), ("tool", r"\d{3}", r"\p{Nd}{3}", "c"), ("tool", r"(?i)^THE .*(?:and|of)", r"^THE [^\n]*(and|of)", "i"),
    ("tool", r"[à-ü&&[^é]]", r"[à-èê-ü]", "c"), ("tool", r"\bé", r"(^|[^\pL\pM\pN_])é", "c"), ("preview", r"^\w+ ", r"^[0-9A-Za-z_]+ ", "i"),
    ("preview", r"[[:alpha:]]", r"[\[:alph]\]", "i"), ("preview", r"^the|[*+]", r"^the|[*+]", "i"), ("preview", r"\bé", r"[0-9A-Za-z_]é", "i"),
    ("preview", r"a{,2}|ß", r"a\{,2}|ß", "i"),
]


def q_regex_dialects(spark, sf):
    """How many texts each pattern is found in, read as its dialect reads it."""
    docs = table(spark, sf, "documents")
    one = docs.agg(*[F.count_if(F.col("text").rlike(java_regex(p, d, d == "preview"))).alias(f"n{i}") for i, (d, p, _, _) in enumerate(_PATTERNS)])
    rows = [F.struct(F.lit(d).alias("dialect"), F.lit(p).alias("pattern"), F.col(f"n{i}").alias("n")) for i, (d, p, _, _) in enumerate(_PATTERNS)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


register("regex_dialects", " UNION ALL ".join(
    f"SELECT {_quoted(d)} AS dialect, {_quoted(p)} AS pattern, cast(count_if(regexp_matches(text, {_quoted(same)}, '{options}')) AS BIGINT) AS n FROM documents"
    for d, p, same, options in _PATTERNS))(q_regex_dialects)
