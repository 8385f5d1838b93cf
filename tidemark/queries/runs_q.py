"""Queries over the run report: X1-X4, F1-F5, X3, G1, K2, K8, A12, A13, A15."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..functions.columns import basename, downloadable, packed_list, size_list
from ..operators.filters import filter_counts, paired_only, preview_keep, regex_filter, regex_keep, selected_counts
from ..operators.runs import capacity_plan, process_runs, study_rollup
from ..plans.resume import file_tasks
from ..sinks.tables import dry_run_plan, mate_checksum_rows
from . import register
from .duck import basename as d_basename
from .duck import packed, processed_cte, sizes

# Filter spec used by the filter queries (fixed test parameters).
INCLUDE_SAMPLE = ["HIGH", "URGENT"]
INCLUDE_RUN = ["[02468]$"]
EXCLUDE_SAMPLE = [" P$"]
EXCLUDE_RUN = ["0000"]


def _runs(spark, sf):
    return view(spark, sf, "run_report")


def _processed(spark, sf):
    return process_runs(_runs(spark, sf))


# ----------------------------------------------------------------- X3 (flagship)
def q_process_runs(spark, sf):
    p = _processed(spark, sf)
    return p.select(*[F.col(c).cast("bigint").alias(c) if c.startswith("fastq_bytes") else F.col(c)
                      for c in p.columns])


register("process_runs", with_views(f"""{processed_cte()}
SELECT run_accession, fastq_ftp_1_url, fastq_ftp_2_url, fastq_ftp_1_name, fastq_ftp_2_name,
  fastq_md5_1, fastq_md5_2, cast(fastq_bytes_1 AS BIGINT) AS fastq_bytes_1,
  cast(fastq_bytes_2 AS BIGINT) AS fastq_bytes_2, sample_title
FROM processed""", "run_report"))(q_process_runs)


# ----------------------------------------------------------------- F1
def q_regex_filter(spark, sf):
    return regex_filter(_runs(spark, sf), INCLUDE_SAMPLE, INCLUDE_RUN, EXCLUDE_SAMPLE, EXCLUDE_RUN) \
        .select("run_accession", "sample_title")


_F1_SQL = """(regexp_matches(coalesce(sample_title, ''), 'HIGH') OR regexp_matches(coalesce(sample_title, ''), 'URGENT'))
  AND regexp_matches(run_accession, '[02468]$')
  AND NOT regexp_matches(coalesce(sample_title, ''), ' P$')
  AND NOT regexp_matches(run_accession, '0000')"""

register("regex_filter", with_views(f"""SELECT run_accession, sample_title FROM run_report
WHERE {_F1_SQL}""", "run_report"))(q_regex_filter)


# ----------------------------------------------------------------- F2
def q_filter_counts(spark, sf):
    return filter_counts(_runs(spark, sf), regex_keep("sample_title", "run_accession", INCLUDE_SAMPLE,
                                                      INCLUDE_RUN, EXCLUDE_SAMPLE, EXCLUDE_RUN))


register("filter_counts", with_views(f"""SELECT cast(count_if({_F1_SQL}) AS BIGINT) AS kept,
  cast(count_if(NOT ({_F1_SQL})) AS BIGINT) AS dropped FROM run_report""", "run_report"))(q_filter_counts)


# ----------------------------------------------------------------- F3 + A12
PREVIEW_SAMPLE = " urgent, high \n\n"
PREVIEW_EXCLUDE_RUN = "5$,"


def q_preview_filter(spark, sf):
    return selected_counts(_runs(spark, sf), preview_keep(filter_sample=PREVIEW_SAMPLE,
                                                          exclude_run=PREVIEW_EXCLUDE_RUN))


register("preview_filter", with_views("""SELECT
  cast(count_if((regexp_matches(coalesce(sample_title, ''), 'urgent', 'i')
      OR regexp_matches(coalesce(sample_title, ''), 'high', 'i'))
    AND NOT regexp_matches(run_accession, '5$', 'i')) AS BIGINT) AS selected,
  cast(count(*) AS BIGINT) AS total
FROM run_report""", "run_report"))(q_preview_filter)


# ----------------------------------------------------------------- F4
def q_downloadable(spark, sf):
    return _runs(spark, sf).select("run_accession", downloadable("fastq_ftp", "fastq_md5").alias("downloadable"))


register("downloadable", with_views(f"""SELECT run_accession,
  len({packed('fastq_ftp')}) > 0 AND len({packed('fastq_md5')}) > 0 AS downloadable
FROM run_report""", "run_report"))(q_downloadable)


# ----------------------------------------------------------------- F5
def q_paired_only(spark, sf):
    return paired_only(_runs(spark, sf)).select(
        "run_accession", F.size(packed_list("fastq_ftp")).cast("bigint").alias("n_urls"))


register("paired_only", with_views(f"""SELECT run_accession, cast(len({packed('fastq_ftp')}) AS BIGINT) AS n_urls
FROM run_report WHERE len({packed('fastq_ftp')}) >= 2""", "run_report"))(q_paired_only)


# ----------------------------------------------------------------- X1
def q_packed_lists(spark, sf):
    r = _runs(spark, sf)
    return r.select("run_accession",
                    F.size(packed_list("fastq_ftp")).cast("bigint").alias("n_urls"),
                    F.size(packed_list("fastq_md5")).cast("bigint").alias("n_md5s"),
                    F.array_join(packed_list("fastq_ftp"), "|").alias("urls"))


register("packed_lists", with_views(f"""SELECT run_accession,
  cast(len({packed('fastq_ftp')}) AS BIGINT) AS n_urls,
  cast(len({packed('fastq_md5')}) AS BIGINT) AS n_md5s,
  array_to_string({packed('fastq_ftp')}, '|') AS urls
FROM run_report""", "run_report"))(q_packed_lists)


# ----------------------------------------------------------------- X2
def q_size_list(spark, sf):
    r = _runs(spark, sf)
    shifted = size_list("fastq_bytes")
    aligned = size_list("fastq_bytes", aligned=True)
    return r.select(
        "run_accession",
        F.size(shifted).cast("bigint").alias("n_sizes"),
        F.array_join(F.transform(shifted, lambda x: x.cast("string")), ",").alias("sizes"),
        F.array_join(F.transform(aligned, lambda x: x.cast("string")), ",", "null").alias("aligned"))


register("size_list", with_views(f"""SELECT run_accession,
  cast(len({sizes('fastq_bytes')}) AS BIGINT) AS n_sizes,
  array_to_string(list_transform({sizes('fastq_bytes')}, lambda v: cast(v AS VARCHAR)), ',') AS sizes,
  array_to_string(list_transform({sizes('fastq_bytes', True)}, lambda v: coalesce(cast(v AS VARCHAR), 'null')), ',') AS aligned
FROM run_report""", "run_report"))(q_size_list)


# ----------------------------------------------------------------- X4
def q_basename(spark, sf):
    return view(spark, sf, "object_listing").select("key", basename("key").alias("name"))


register("basename", with_views(f"""SELECT key, {d_basename('key')} AS name FROM object_listing""",
                                "object_listing"))(q_basename)


# ----------------------------------------------------------------- G1
def q_file_tasks(spark, sf):
    t = file_tasks(_processed(spark, sf))
    return t.select("run_accession", F.col("mate").cast("bigint").alias("mate"), "url", "md5", "filename",
                    F.col("total_size").cast("bigint").alias("total_size"))


register("file_tasks", with_views(f"""{processed_cte()}
SELECT run_accession, cast(1 AS BIGINT) AS mate, fastq_ftp_1_url AS url, fastq_md5_1 AS md5,
  fastq_ftp_1_name AS filename, cast(fastq_bytes_1 AS BIGINT) AS total_size FROM processed
UNION ALL
SELECT run_accession, cast(2 AS BIGINT), fastq_ftp_2_url, fastq_md5_2, fastq_ftp_2_name,
  cast(fastq_bytes_2 AS BIGINT) FROM processed
WHERE fastq_ftp_2_url IS NOT NULL AND fastq_md5_2 IS NOT NULL AND fastq_ftp_2_name IS NOT NULL
  AND fastq_bytes_2 IS NOT NULL""", "run_report"))(q_file_tasks)


# ----------------------------------------------------------------- K8
def q_dry_run_plan(spark, sf):
    d = dry_run_plan(_processed(spark, sf))
    return d.select("run_accession", F.col("mate").cast("bigint").alias("mate"), "filename",
                    F.col("size").cast("bigint").alias("size"))


register("dry_run_plan", with_views(f"""{processed_cte()}
SELECT run_accession, cast(1 AS BIGINT) AS mate, fastq_ftp_1_name AS filename,
  cast(fastq_bytes_1 AS BIGINT) AS size FROM processed
UNION ALL
SELECT run_accession, cast(2 AS BIGINT), fastq_ftp_2_name, cast(fastq_bytes_2 AS BIGINT) FROM processed
WHERE fastq_ftp_2_name IS NOT NULL AND fastq_bytes_2 IS NOT NULL""", "run_report"))(q_dry_run_plan)


# ----------------------------------------------------------------- K2
def q_mate_checksums(spark, sf):
    m = mate_checksum_rows(_processed(spark, sf))
    return m.select(F.col("mate").cast("bigint").alias("mate"), "md5", "filename", "sample_title")


register("mate_checksums", with_views(f"""{processed_cte()}
SELECT cast(1 AS BIGINT) AS mate, fastq_md5_1 AS md5, fastq_ftp_1_name AS filename, sample_title FROM processed
UNION ALL
SELECT cast(2 AS BIGINT), fastq_md5_2, fastq_ftp_2_name, sample_title FROM processed
WHERE fastq_md5_2 IS NOT NULL AND fastq_ftp_2_name IS NOT NULL""", "run_report"))(q_mate_checksums)


# ----------------------------------------------------------------- A13
def q_capacity_plan(spark, sf):
    c = capacity_plan(_processed(spark, sf))
    return c.select(F.col("runs").cast("bigint").alias("runs"),
                    F.col("planned_bytes").cast("bigint").alias("planned_bytes"),
                    F.round("expanded_bytes", 6).alias("expanded_bytes"))


register("capacity_plan", with_views(f"""{processed_cte()}
SELECT cast(count(*) AS BIGINT) AS runs,
  cast(coalesce(sum(fastq_bytes_1 + coalesce(fastq_bytes_2, 0)), 0) AS BIGINT) AS planned_bytes,
  round(cast(coalesce(sum(fastq_bytes_1 + coalesce(fastq_bytes_2, 0)), 0) AS DOUBLE) * 3.0, 6) AS expanded_bytes
FROM processed""", "run_report"))(q_capacity_plan)


# ----------------------------------------------------------------- A15
def q_study_rollup(spark, sf):
    r = study_rollup(_runs(spark, sf), ["library_layout", "study_accession"])
    return r.select("library_layout", "study_accession", F.col("runs").cast("bigint").alias("runs"),
                    F.col("level").cast("bigint").alias("level"))


register("study_rollup", with_views("""SELECT library_layout, study_accession, cast(count(*) AS BIGINT) AS runs,
  cast(grouping(library_layout, study_accession) AS BIGINT) AS level
FROM run_report GROUP BY ROLLUP (library_layout, study_accession)""", "run_report"))(q_study_rollup)
