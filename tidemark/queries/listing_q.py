"""Queries over object listings and the catalogue: S3, S4, F6, X5, X6, X8,
X9, X10, A3, A4, A5, A11, J6, J7, W5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import register_tables, view, with_views
from ..functions.columns import etag_md5, file_stem, s3_parse, s3_to_https
from ..operators.catalog import (failed_volumes, lookup_catalog, match_catalog, missing_parts, volume_attempts,
                                 volume_validation, volumes)
from ..schemas import VOLUME_EXTENSIONS
from ..sources.listing import clean_listing, lookup_objects
from . import register

PREFIX = "2026-01/"
W_EXCLUDE = "n*"
W_INCLUDE = "nr.00?.p*"
W5_ORDER = ("attempt", "p", "q", "x", "outcome")


def _listing(spark, sf):
    return view(spark, sf, "object_listing")


def _name(col: str) -> str:
    return f"regexp_extract({col}, '[^/]*$')"


def _stem(col: str) -> str:
    return f"regexp_replace({_name(col)}, '^(.+)[.][^.]*$', '\\1')"


def _ext(col: str) -> str:
    return (f"CASE WHEN regexp_matches({_name(col)}, '^.+[.][^.]*$') "
            f"THEN regexp_extract({_name(col)}, '[.]([^.]*)$', 1) END")


def _like(p: str) -> str:
    return f"replace(replace(replace(replace(replace({p}, '!', '!!'), '%', '!%'), '_', '!_'), '*', '%'), '?', '_')"


_MD5 = ("CASE WHEN regexp_full_match(trim(etag, '\"'), '[0-9A-Fa-f]{32}') "
        "THEN lower(trim(etag, '\"')) END")
_CLEAN = "key IS NOT NULL AND size IS NOT NULL AND NOT (ends_with(key, '/') AND size = 0)"


# ----------------------------------------------------------------- S3
def q_object_listing_clean(spark, sf):
    return clean_listing(_listing(spark, sf)).select("bucket", "key", "size", "md5")


register("object_listing_clean", with_views(f"""SELECT bucket, key, size, {_MD5} AS md5
FROM object_listing WHERE {_CLEAN}""", "object_listing"))(q_object_listing_clean)


# ----------------------------------------------------------------- S4
_REQ = "SELECT bucket, key || CASE WHEN length(key) % 3 = 0 THEN '.missing' ELSE '' END AS key FROM object_listing"


def q_object_lookup(spark, sf):
    register_tables(spark, sf, ["part"])
    _listing(spark, sf).createOrReplaceTempView("object_listing")
    req = spark.sql(_REQ)
    return lookup_objects(_listing(spark, sf), req).select("bucket", "key", "size", "md5", "status")


register("object_lookup", with_views(f"""SELECT r.bucket, r.key, o.size, {_MD5.replace('etag', 'o.etag')} AS md5,
  CASE WHEN r.key = '' OR ends_with(r.key, '/') THEN 'bad key'
       WHEN o.key IS NULL THEN 'missing' WHEN o.size IS NULL THEN 'no size' ELSE 'found' END AS status
FROM ({_REQ}) r LEFT JOIN object_listing o ON o.bucket = r.bucket AND o.key = r.key""",
                                     "object_listing"))(q_object_lookup)


# ----------------------------------------------------------------- F6 + X10
def q_wildcard_filter(spark, sf):
    return clean_listing(_listing(spark, sf), PREFIX, W_EXCLUDE, W_INCLUDE).select("key", "rel_key")


register("wildcard_filter", with_views(f"""SELECT key, rel_key FROM (
  SELECT key, CASE WHEN starts_with(key, '{PREFIX}') THEN substr(key, {len(PREFIX) + 1}) ELSE key END AS rel_key
  FROM object_listing WHERE {_CLEAN} AND starts_with(key, '{PREFIX}')) t
WHERE rel_key LIKE {_like(repr(W_INCLUDE))} ESCAPE '!' OR NOT (rel_key LIKE {_like(repr(W_EXCLUDE))} ESCAPE '!')""",
                                       "object_listing"))(q_wildcard_filter)


# ----------------------------------------------------------------- X8
def q_etag_md5(spark, sf):
    return _listing(spark, sf).select("key", "etag", etag_md5("etag").alias("md5"))


register("etag_md5", with_views(f"SELECT key, etag, {_MD5} AS md5 FROM object_listing",
                                "object_listing"))(q_etag_md5)


# ----------------------------------------------------------------- X9
def q_file_stem(spark, sf):
    return _listing(spark, sf).select("key", file_stem("key").alias("stem"))


register("file_stem", with_views(f"SELECT key, {_stem('key')} AS stem FROM object_listing",
                                 "object_listing"))(q_file_stem)


# ----------------------------------------------------------------- X5
_URLS = """SELECT p_partkey AS id, CASE p_partkey % 7
    WHEN 0 THEN 's3://blast-db/' || p_brand || '/' || p_name
    WHEN 1 THEN '  s3://blast-db-' || cast(p_size AS string) || '  '
    WHEN 2 THEN 'https://blast-db.s3.amazonaws.com/' || p_name
    WHEN 3 THEN 's3:///' || p_name
    WHEN 4 THEN 's3://bad?' || p_type || '/x'
    WHEN 5 THEN 's3://b#' || p_type
    ELSE 's3://' || lower(p_type) || '/' || p_name || '/' END AS url
FROM part"""


def q_s3_parse(spark, sf):
    register_tables(spark, sf, ["part"])
    u = spark.sql(_URLS)
    return u.select("id", "url", s3_parse("url").alias("p")).select("id", "url", "p.bucket", "p.key", "p.error")


register("s3_parse", f"""SELECT id, url, CASE WHEN error IS NULL THEN bucket END AS bucket,
  CASE WHEN error IS NULL THEN key END AS key, error
FROM (SELECT id, url, bucket, key,
  CASE WHEN v IS NULL THEN 'null url' WHEN NOT starts_with(v, 's3://') THEN 'not an s3 url'
       WHEN bucket = '' THEN 'missing bucket'
       WHEN contains(bucket, '?') OR contains(bucket, '#') THEN 'invalid bucket' END AS error
  FROM (SELECT id, url, v,
      CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END AS bucket,
      CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/') + 1) ELSE '' END AS key
    FROM (SELECT id, url, trim(url) AS v,
        CASE WHEN starts_with(trim(url), 's3://') THEN substr(trim(url), 6) END AS rest
      FROM ({_URLS}) u) a) b) c""")(q_s3_parse)


# ----------------------------------------------------------------- X6
_KEYS = """SELECT p_partkey AS id, 'blast-db' AS bucket, p_brand || '/' || p_name || CASE p_partkey % 5
    WHEN 0 THEN '?v=1' WHEN 1 THEN ' {x}' WHEN 2 THEN '+a=b@c,(d)!~' WHEN 3 THEN '%41<"q">`' ELSE '' END AS key
FROM part"""


def q_s3_to_https(spark, sf):
    register_tables(spark, sf, ["part"])
    k = spark.sql(_KEYS)
    return k.select("id", "key", s3_to_https("bucket", "key").alias("url"))


_ENC = "ltrim(key, '/')"
for _ch, _esc in [(" ", "%20"), ('"', "%22"), ("#", "%23"), ("<", "%3C"), (">", "%3E"), ("?", "%3F"),
                  ("`", "%60"), ("{", "%7B"), ("}", "%7D")]:
    _ENC = f"replace({_ENC}, '{_ch}', '{_esc}')"

register("s3_to_https", f"""SELECT id, key, 'https://' || bucket || '.s3.amazonaws.com/' || {_ENC} AS url
FROM ({_KEYS}) k""")(q_s3_to_https)


# ----------------------------------------------------------------- A3
def _clean_prefixed(spark, sf):
    return clean_listing(_listing(spark, sf), PREFIX)


def q_volumes(spark, sf):
    v = volumes(_clean_prefixed(spark, sf))
    return v.select("volume", F.col("n_objects").cast("bigint").alias("n_objects"),
                    F.col("total_bytes").cast("bigint").alias("total_bytes"), "first_key", "last_key")


register("volumes", with_views(f"""SELECT {_stem('key')} AS volume, cast(count(*) AS BIGINT) AS n_objects,
  cast(sum(size) AS BIGINT) AS total_bytes, min(key) AS first_key, max(key) AS last_key
FROM object_listing WHERE {_CLEAN} AND starts_with(key, '{PREFIX}') GROUP BY 1""",
                               "object_listing"))(q_volumes)


# ----------------------------------------------------------------- A5
def q_volume_missing_parts(spark, sf):
    return missing_parts(_clean_prefixed(spark, sf)).select("volume", "extension")


_EXT_VALUES = ", ".join(f"('{e}')" for e in VOLUME_EXTENSIONS)
register("volume_missing_parts", with_views(f"""present AS (
  SELECT DISTINCT {_stem('key')} AS volume, {_ext('key')} AS extension
  FROM object_listing WHERE {_CLEAN} AND starts_with(key, '{PREFIX}'))
SELECT v.volume, e.extension FROM (SELECT DISTINCT volume FROM present) v
CROSS JOIN (VALUES {_EXT_VALUES}) e(extension)
WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.volume = v.volume AND p.extension = e.extension)""",
                                            "object_listing"))(q_volume_missing_parts)


# ----------------------------------------------------------------- J6
def q_catalog_match(spark, sf):
    cat = view(spark, sf, "catalog_entries")
    m = match_catalog(cat, _listing(spark, sf))
    return m.select("name", "key", "rel_key", "size", "md5")


register("catalog_match", with_views(f"""cat AS (
  SELECT name, substr(s3_url, 6, strpos(substr(s3_url, 6), '/') - 1) AS cb,
    substr(s3_url, 6 + strpos(substr(s3_url, 6), '/')) AS cp, exclude, include FROM catalog_entries)
SELECT name, key, rel_key, size, md5 FROM (
  SELECT c.name, o.key, substr(o.key, length(c.cp) + 1) AS rel_key, o.size,
    {_MD5.replace('etag', 'o.etag')} AS md5, c.exclude, c.include
  FROM object_listing o JOIN cat c ON o.bucket = c.cb AND starts_with(o.key, c.cp)
  WHERE o.key IS NOT NULL AND o.size IS NOT NULL AND NOT (ends_with(o.key, '/') AND o.size = 0)) t
WHERE coalesce(rel_key LIKE {_like('include')} ESCAPE '!', false)
   OR NOT coalesce(rel_key LIKE {_like('exclude')} ESCAPE '!', false)""",
                                     "object_listing", "catalog_entries"))(q_catalog_match)


# ----------------------------------------------------------------- J7
_REQ_NAMES = f"SELECT DISTINCT split_part({_name('key')}, '.', 1) AS name FROM object_listing"


def q_catalog_lookup(spark, sf):
    cat = view(spark, sf, "catalog_entries")
    req = _listing(spark, sf).select(F.split(F.substring_index("key", "/", -1), r"\.").getItem(0).alias("name")) \
        .distinct()
    return lookup_catalog(cat, req, list_names=True).select("name", "found", "s3_url", "error")


register("catalog_lookup", with_views(f"""SELECT r.name, c.s3_url IS NOT NULL AS found, c.s3_url,
  CASE WHEN c.s3_url IS NULL THEN 'Unknown database ''' || r.name || '''. Available: '
    || (SELECT string_agg(name, ', ' ORDER BY name) FROM catalog_entries) END AS error
FROM ({_REQ_NAMES}) r LEFT JOIN catalog_entries c ON c.name = r.name""",
                                      "object_listing", "catalog_entries"))(q_catalog_lookup)


# ----------------------------------------------------------------- W5
_W5_SQL = """r AS (SELECT *, row_number() OVER (PARTITION BY volume, batch, outcome = 'corrupted'
      ORDER BY attempt, p, q, x, outcome) AS rk FROM volume_outcomes),
t AS (SELECT volume, batch, outcome, row_number() OVER (PARTITION BY volume, batch
      ORDER BY attempt, p, q, x, outcome) AS n
    FROM r WHERE outcome IN ('valid', 'tool_error') OR (outcome = 'corrupted' AND rk = 3)),
w5 AS (SELECT g.volume, g.batch,
    CASE WHEN t.outcome = 'valid' THEN 'validated' WHEN t.outcome IS NULL THEN 'incomplete' ELSE 'failed' END AS status,
    CASE WHEN t.outcome = 'tool_error' THEN 'Volume ' || g.volume || ' validation command failed'
         WHEN t.outcome = 'corrupted' THEN 'Volume ' || g.volume || ' failed validation after 2 retries' END AS error
  FROM (SELECT DISTINCT volume, batch FROM volume_outcomes) g
  LEFT JOIN (SELECT * FROM t WHERE n = 1) t ON t.volume = g.volume AND t.batch = g.batch)"""


def _w5(spark, sf):
    return volume_attempts(view(spark, sf, "volume_outcomes"), max_retries=2, order=W5_ORDER)


def q_volume_attempts(spark, sf):
    return _w5(spark, sf).select("volume", "batch", "status", "error")


register("volume_attempts", with_views(f"""{_W5_SQL}
SELECT volume, batch, status, error FROM w5""", "volume_outcomes"))(q_volume_attempts)


# ----------------------------------------------------------------- A4
def q_volume_validation(spark, sf):
    o = view(spark, sf, "volume_outcomes")
    latest = o.groupBy("volume").agg(
        F.max_by("outcome", F.struct("batch", *W5_ORDER)).alias("outcome"))
    r = volume_validation(_listing(spark, sf), latest, PREFIX)
    return r.select(F.col("passed").cast("bigint").alias("passed"), F.col("failed").cast("bigint").alias("failed"))


register("volume_validation", with_views(f"""latest AS (
  SELECT volume, outcome FROM (SELECT volume, outcome, row_number() OVER (PARTITION BY volume
      ORDER BY batch DESC, attempt DESC, p DESC, q DESC, x DESC, outcome DESC) AS n FROM volume_outcomes) z
  WHERE n = 1),
vols AS (SELECT DISTINCT {_stem('rel')} AS volume FROM (
    SELECT substr(key, {len(PREFIX) + 1}) AS rel FROM object_listing WHERE starts_with(key, '{PREFIX}')) a
  WHERE NOT contains(rel, '/') AND ends_with(rel, '.phr'))
SELECT cast(count_if(l.outcome = 'valid') AS BIGINT) AS passed,
  cast(count_if(l.outcome IS NULL OR l.outcome <> 'valid') AS BIGINT) AS failed
FROM vols v LEFT JOIN latest l ON l.volume = v.volume""", "object_listing", "volume_outcomes"))(q_volume_validation)


# ----------------------------------------------------------------- A11
def q_failed_volumes(spark, sf):
    f = failed_volumes(_w5(spark, sf), _clean_prefixed(spark, sf), order_col="batch")
    return f.select("volume", "error", "uri")


register("failed_volumes", with_views(f"""{_W5_SQL},
fv AS (SELECT volume, arg_min(error, batch) AS error FROM w5 WHERE status = 'failed' GROUP BY volume)
SELECT fv.volume, fv.error, 's3://' || o.bucket || '/' || o.key AS uri
FROM fv LEFT JOIN (SELECT * FROM object_listing WHERE {_CLEAN} AND starts_with(key, '{PREFIX}')) o
  ON {_stem('o.key')} = fv.volume""", "object_listing", "volume_outcomes"))(q_failed_volumes)


# ----------------------------------------------------------------- K8 (public data)
def q_public_dry_run(spark, sf):
    from ..sinks.tables import listing_plan
    cat = view(spark, sf, "catalog_entries")
    return listing_plan(match_catalog(cat, _listing(spark, sf))).select("name", "key", "size", "size_text")


register("public_dry_run", with_views(f"""cat AS (
  SELECT name, substr(s3_url, 6, strpos(substr(s3_url, 6), '/') - 1) AS cb,
    substr(s3_url, 6 + strpos(substr(s3_url, 6), '/')) AS cp, exclude, include FROM catalog_entries),
m AS (SELECT name, key, size FROM (
  SELECT c.name, o.key, substr(o.key, length(c.cp) + 1) AS rel_key, o.size, c.exclude, c.include
  FROM object_listing o JOIN cat c ON o.bucket = c.cb AND starts_with(o.key, c.cp)
  WHERE o.key IS NOT NULL AND o.size IS NOT NULL AND NOT (ends_with(o.key, '/') AND o.size = 0)) t
  WHERE coalesce(rel_key LIKE {_like('include')} ESCAPE '!', false)
     OR NOT coalesce(rel_key LIKE {_like('exclude')} ESCAPE '!', false))
SELECT name, key, size, CASE WHEN size = 0 THEN '0 B' WHEN size < 1024 THEN cast(size AS VARCHAR) || ' B'
  WHEN size < 1048576 THEN format('{{:.1f}}', size / 1024.0) || ' KiB'
  WHEN size < 1073741824 THEN format('{{:.1f}}', size / 1048576.0) || ' MiB'
  ELSE format('{{:.1f}}', size / 1073741824.0) || ' GiB' END AS size_text
FROM m""", "object_listing", "catalog_entries"))(q_public_dry_run)
