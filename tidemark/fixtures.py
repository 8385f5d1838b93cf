"""Domain inputs derived from the driver tables.

Each view is one SELECT whose text runs unchanged in Spark SQL and DuckDB, so
the Spark operator and its SQL oracle start from identical rows.  Every view
reads whole tables (no row caps, no sampling); the residues below only choose
which trap a row exercises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {}

# Run report: residue of the order key mod 6 picks the file layout --
# 0 no files, 1 single, 2 paired, 3 bad first size, 4 one md5 for two urls,
# 5 three files.
VIEWS["run_report"] = """
SELECT r AS run_accession, 'PRJNA' || cast(c AS string) AS study_accession,
  CASE WHEN k % 7 = 0 THEN '' ELSE p || ' ' || s END AS sample_title,
  CASE WHEN k % 6 = 1 THEN 'SINGLE' ELSE 'PAIRED' END AS library_layout,
  CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN d || '.fastq.gz'
    WHEN 5 THEN d || '.fastq.gz;' || d || '_1.fastq.gz;' || d || '_2.fastq.gz'
    ELSE d || '_1.fastq.gz;' || d || '_2.fastq.gz' END AS fastq_ftp,
  CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN md5(r) WHEN 4 THEN md5(r || '_1')
    WHEN 5 THEN md5(r) || ';' || md5(r || '_1') || ';' || md5(r || '_2')
    ELSE md5(r || '_1') || ';' || md5(r || '_2') END AS fastq_md5,
  CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN b WHEN 3 THEN 'n/a;' || b
    WHEN 5 THEN '10;' || b || ';' || b ELSE b || ';' || b || '0' END AS fastq_bytes
FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, o_orderstatus AS s,
        'SRR' || lpad(cast(o_orderkey AS string), 8, '0') AS r,
        'ftp.example.org/vol1/SRR' || lpad(cast(o_orderkey AS string), 8, '0') || '/SRR'
          || lpad(cast(o_orderkey AS string), 8, '0') AS d,
        cast(cast(floor(o_totalprice) AS bigint) AS string) AS b
      FROM orders) t
"""

# Object listing: null sizes, directory markers, multipart and upper-case ETags.
VIEWS["object_listing"] = """
SELECT 'blast-db' AS bucket,
  CASE WHEN p_partkey % 101 = 0 THEN '2026-01/sub' || cast(p_partkey AS string) || '/'
    ELSE '2026-01/' || CASE p_partkey % 3 WHEN 0 THEN 'nt' WHEN 1 THEN 'nr' ELSE 'tax_db' END
      || '.' || lpad(cast(cast(floor(p_partkey / 30) AS bigint) AS string), 3, '0')
      || CASE cast(floor(p_partkey / 3) AS bigint) % 10
           WHEN 0 THEN '.phr' WHEN 1 THEN '.psq' WHEN 2 THEN '.pin' WHEN 3 THEN '.pog'
           WHEN 4 THEN '.pni' WHEN 5 THEN '.pnd' WHEN 6 THEN '.psi' WHEN 7 THEN '.psd'
           WHEN 8 THEN '.aln' ELSE '.freq' END END AS key,
  CASE WHEN p_partkey % 101 = 0 THEN cast(0 AS bigint)
    WHEN p_partkey % 97 = 0 THEN NULL
    ELSE cast(floor(p_retailprice * 1000) AS bigint) END AS size,
  '"' || CASE WHEN p_partkey % 5 = 0 THEN upper(md5(p_name)) ELSE md5(p_name) END
    || CASE WHEN p_partkey % 4 = 0 THEN '-2' ELSE '' END || '"' AS etag
FROM part
"""

# Checksum manifest entries: own log every 50th, upper-case md5 on even ids.
VIEWS["manifest_entries"] = """
SELECT CASE WHEN doc_id % 50 = 0 THEN 'transfer_md5_' || cast(doc_id AS string) || '.log'
         ELSE 'doc_' || cast(doc_id AS string) || '.txt' END AS filename,
  CASE WHEN doc_id % 2 = 0 THEN upper(md5(text)) ELSE md5(text) END AS md5
FROM documents
"""

# Local inventory: every document is on disk, but every 23rd only as an
# unfinished ``.part`` file (so its manifest entry is MISSING) and every 17th
# has corrupt content.
VIEWS["inventory"] = """
SELECT '/data/' || source || '/doc_' || cast(doc_id AS string) || '.txt'
    || CASE WHEN doc_id % 23 = 0 THEN '.part' ELSE '' END AS path,
  'doc_' || cast(doc_id AS string) || '.txt'
    || CASE WHEN doc_id % 23 = 0 THEN '.part' ELSE '' END AS filename,
  n_chars AS length,
  md5(CASE WHEN doc_id % 17 = 0 THEN text || 'x' ELSE text END) AS actual_md5
FROM documents
"""

# Manifest text lines (S5): comments, blanks, single-space separators, bad
# digests, a name with an inner double space, padding and upper case.
VIEWS["manifest_text"] = """
SELECT 'md5_' || source || '.txt' AS file, doc_id + 1 AS line_no,
  CASE WHEN doc_id % 29 = 0 THEN '# comment ' || cast(doc_id AS string)
    WHEN doc_id % 31 = 0 THEN '   '
    WHEN doc_id % 37 = 0 THEN md5(text) || ' doc_' || cast(doc_id AS string) || '.txt'
    WHEN doc_id % 41 = 0 THEN 'z' || substr(md5(text), 2) || '  doc_' || cast(doc_id AS string) || '.txt'
    WHEN doc_id % 43 = 0 THEN md5(text) || '  dir/doc  ' || cast(doc_id AS string) || '.txt'
    ELSE ' ' || CASE WHEN doc_id % 2 = 0 THEN upper(md5(text)) ELSE md5(text) END
      || '  doc_' || cast(doc_id AS string) || '.txt ' END AS line
FROM documents
"""

# A directory tree (S6, K3): hidden directories and files, the tool's logs.
VIEWS["inventory_paths"] = """
SELECT '/data/' || CASE WHEN doc_id % 13 = 0 THEN '.cache/' ELSE '' END || source || '/'
    || CASE WHEN doc_id % 19 = 0 THEN '.' WHEN doc_id % 50 = 0 THEN 'transfer_md5_' ELSE '' END
    || 'doc_' || cast(doc_id AS string) || CASE WHEN doc_id % 50 = 0 THEN '.log' ELSE '.txt' END AS path,
  n_chars AS length, md5(text) AS actual_md5
FROM documents
"""

# Remote files for the range engine: size 0 every 40th, unknown md5 every 3rd.
VIEWS["remote_files"] = """
SELECT 'SRR' || lpad(cast(o_orderkey AS string), 8, '0') AS file_id,
  CASE WHEN o_orderkey % 40 = 0 THEN cast(0 AS bigint)
    ELSE cast(floor(o_totalprice) AS bigint) END AS size,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL
    ELSE md5(cast(o_orderkey AS string)) END AS md5
FROM orders
"""

# Finished chunk ids (repeats included; those of returned lines lie outside the plan).
VIEWS["chunk_state"] = """
SELECT 'SRR' || lpad(cast(l_orderkey AS string), 8, '0') AS file_id,
  cast(l_linenumber - 1 + CASE WHEN l_returnflag = 'A' THEN 1000000 ELSE 0 END AS bigint) AS chunk_id
FROM lineitem
"""

# Chunk-state documents (S9): valid lists with repeats, invalid JSON, a
# missing field, an empty list and a negative id (which voids the state).
VIEWS["chunk_state_json"] = """
SELECT 'SRR' || lpad(cast(o_orderkey AS string), 8, '0') AS file_id,
  CASE o_orderkey % 6 WHEN 0 THEN '{"downloaded_chunks":[0,2,2]}'
    WHEN 1 THEN 'not json {'
    WHEN 2 THEN '{"downloaded_chunks":[]}'
    WHEN 3 THEN '{"downloaded_chunks":[' || cast(o_custkey % 7 AS string) || ','
      || cast(o_custkey % 3 AS string) || ',' || cast(o_custkey % 11 AS string) || ']}'
    WHEN 4 THEN '{"other":[1]}'
    ELSE '{"downloaded_chunks":[3,-1]}' END AS state_json
FROM orders
"""

# Local copies for the range engine: status F = same size, O = other size,
# P = only a temporary file (no local copy under the file id).
VIEWS["local_files"] = """
SELECT CASE WHEN o_orderstatus = 'P' THEN 'tmp_' ELSE '' END
    || 'SRR' || lpad(cast(o_orderkey AS string), 8, '0') AS file_id,
  CASE WHEN o_orderkey % 40 = 0 THEN cast(0 AS bigint)
    ELSE cast(floor(o_totalprice) AS bigint) END
    + CASE WHEN o_orderstatus = 'O' THEN 7 ELSE 0 END AS local_size,
  CASE WHEN o_custkey % 2 = 0 THEN md5(cast(o_orderkey AS string)) ELSE md5('other') END AS local_md5
FROM orders
"""

# Local copies for the FTP path, named like mate-1 files: F complete (md5
# right on even customers), O half-written, P empty.
VIEWS["ftp_local"] = """
SELECT 'SRR' || lpad(cast(o_orderkey AS string), 8, '0') || '_1.fastq.gz' AS filename,
  CASE o_orderstatus WHEN 'F' THEN cast(floor(o_totalprice) AS bigint)
    WHEN 'O' THEN cast(floor(o_totalprice / 2) AS bigint) ELSE cast(0 AS bigint) END AS local_size,
  CASE WHEN o_custkey % 2 = 0 THEN md5('SRR' || lpad(cast(o_orderkey AS string), 8, '0') || '_1')
    ELSE md5('stale') END AS local_md5
FROM orders
"""

# Converter outputs (J9): F -> X_1.fastq, O -> X.fastq, P -> only X_2.fastq;
# empty files every 9th customer.
VIEWS["conversion_outputs"] = """
SELECT 'SRR' || lpad(cast(o_orderkey AS string), 8, '0')
    || CASE o_orderstatus WHEN 'F' THEN '_1.fastq' WHEN 'O' THEN '.fastq' ELSE '_2.fastq' END AS filename,
  CASE WHEN o_custkey % 9 = 0 THEN cast(0 AS bigint) ELSE cast(floor(o_totalprice) AS bigint) END AS length
FROM orders
"""

# Transfer events: one feed per user.
VIEWS["transfer_events"] = """
SELECT event_id, ts, 'SRR' || lpad(cast(user_id AS string), 8, '0') AS run_id,
  CASE event_type WHEN 'signup' THEN 'downloading' WHEN 'view' THEN 'extracting'
    WHEN 'click' THEN 'compressing' WHEN 'purchase' THEN 'completed'
    ELSE 'failed' END AS stage,
  cast(floor(value * 1000) AS bigint) AS bytes_done, cast(300000 AS bigint) AS bytes_total,
  CASE WHEN event_type = 'error' THEN 'error ' || cast(event_id % 5 AS string) END AS error
FROM events
"""

# Tagged JSON events (S12): ``k`` picks the kind -- 3 has an unknown type, 4 is no JSON,
# 5 lacks a field, 7 has a field of another kind, 6 has no data.
VIEWS["tagged_lines"] = """
SELECT event_id, k, CASE k WHEN 0 THEN '{"type":"Log","data":{"level":"INFO","message":"run ' || run_id || '"}}'
    WHEN 1 THEN '{"data":{"total":' || b || ',"more":1},"type":"Started"}'
    WHEN 2 THEN '{"type":"Error","data":{"message":"' || coalesce(error, 'none') || '"}}'
    WHEN 3 THEN '{"type":"Paused","data":{"run_id":"' || run_id || '"}}'
    WHEN 4 THEN 'not json ' || run_id
    WHEN 5 THEN '{"type":"Progress","data":{"run_id":"' || run_id || '","percent":1}}'
    WHEN 6 THEN '{"type":"Completed"}'
    WHEN 7 THEN '{"type":"Started","data":{"total":"' || run_id || '"}}'
    ELSE '{"type":"Progress","data":{"run_id":"' || run_id || '","percent":' || cast(bytes_done % 100 AS string)
      || ',"status":"' || stage || '","speed_mbps":' || cast(bytes_done % 1000 AS string) || '.5}}' END AS line
FROM (SELECT event_id, event_id % 11 AS k, 'SRR' || lpad(cast(user_id AS string), 8, '0') AS run_id,
        CASE event_type WHEN 'signup' THEN 'downloading' WHEN 'view' THEN 'extracting' WHEN 'click' THEN 'compressing'
          WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS stage,
        cast(floor(value * 1000) AS bigint) AS bytes_done, cast(cast(floor(value * 1000) AS bigint) AS string) AS b,
        CASE WHEN event_type = 'error' THEN 'error ' || cast(event_id % 5 AS string) END AS error
      FROM events) t
"""

# Transfer log lines.
VIEWS["log_lines"] = """
SELECT event_id, '[' || cast(date_trunc('second', ts) AS string) || '.000] ['
  || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END
  || '] run ' || cast(user_id AS string) || ' ' || event_type AS line
FROM events
"""

# Run XML documents: odd suppliers have a free-egress AWS copy.
VIEWS["sra_xml"] = """
SELECT 'SRR' || lpad(cast(s_suppkey AS string), 8, '0') AS run_id,
  '<RUN_SET><RUN><SRAFiles><SRAFile md5="' || md5(s_name) || '" size="'
    || cast(s_suppkey * 1000 AS string) || '"><Alternatives org="AWS" free_egress="'
    || CASE WHEN s_suppkey % 2 = 1 THEN 'worldwide' ELSE '-' END
    || '" url="https://odp.s3.amazonaws.com/sra/' || cast(s_suppkey AS string)
    || '"/></SRAFile></SRAFiles></RUN></RUN_SET>' AS xml
FROM supplier
"""

# Files offered for upload.
VIEWS["upload_files"] = """
SELECT '/in/' || cast(p_partkey AS string) || CASE p_partkey % 6 WHEN 0 THEN '.fastq.gz'
    WHEN 1 THEN '.fq.gz' WHEN 2 THEN '.bam' WHEN 3 THEN '.cram' WHEN 4 THEN '.vcf.gz'
    ELSE '.txt' END AS path,
  CASE WHEN p_partkey % 11 = 0 THEN cast(0 AS bigint) ELSE cast(p_size AS bigint) END AS length
FROM part
"""

# Catalogue entries (name, s3_url, database_type, exclude, include).  The
# patterns test escaping of `_` and that `?` is one character.
VIEWS["catalog_entries"] = """
SELECT * FROM (VALUES
  ('nt', 's3://blast-db/2026-01/', 'folder', '*', 'nt.*'),
  ('nr', 's3://blast-db/2026-01/', 'folder', '*', 'nr.*'),
  ('all', 's3://blast-db/2026-01/', 'folder', '*', '*'),
  ('open', 's3://blast-db/2026-01/', 'folder', NULL, NULL),
  ('incl_only', 's3://blast-db/2026-01/', 'folder', NULL, 'nt.*'),
  ('tax', 's3://blast-db/2026-01/', 'folder', '*', 'tax_db.00?.*')
) AS v(name, s3_url, database_type, exclude, include)
"""

# Volume validation outcomes (one per attempt), derived from line items:
# the line number is the attempt, the return flag the result.
VIEWS["volume_outcomes"] = """
SELECT CASE l_partkey % 3 WHEN 0 THEN 'nt' WHEN 1 THEN 'nr' ELSE 'tax_db' END
    || '.' || lpad(cast(cast(floor(l_partkey / 30) AS bigint) AS string), 3, '0') AS volume,
  l_orderkey AS batch, l_linenumber AS attempt, l_partkey AS p, l_suppkey AS q, l_extendedprice AS x,
  CASE l_returnflag WHEN 'N' THEN 'valid' WHEN 'R' THEN 'corrupted' ELSE
    CASE WHEN l_linestatus = 'O' THEN 'tool_error' ELSE 'valid' END END AS outcome
FROM lineitem
"""

# Chunk attempts (W4, O3): per (file, chunk) a sequence of attempts.
VIEWS["chunk_attempts"] = """
SELECT 'SRR' || lpad(cast(l_orderkey AS string), 8, '0') AS file_id,
  cast(l_linenumber - 1 AS bigint) AS chunk_id,
  l_partkey AS p, l_suppkey AS q, l_quantity AS n, l_extendedprice AS x, l_discount AS dsc, l_tax AS tx,
  l_returnflag = 'N' AS ok,
  CASE WHEN l_linestatus = 'O' THEN 'range' ELSE 'stream' END AS kind,
  l_returnflag = 'R' AS progressed
FROM lineitem
"""


_SCANS: dict = {}
_REGISTERED: dict = {}

# Key column of each driver table (used to spread a scan that yields fewer
# splits than the cluster has cores).
TABLE_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
              "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id",
              "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id",
              "labels": "doc_id", "conversations": "conv_id"}


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Hash-repartition a scan on its key when it has fewer input splits than
    the session's parallelism (e.g. a file with one row group).  At scale the
    scan already has thousands of splits and this is a no-op.  The setting
    ``spark.tidemark.spread`` = ``never`` leaves scans as they are."""
    if df.sparkSession.conf.get("spark.tidemark.spread", "auto") == "never":
        return df
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= par:
        return df
    return df.repartition(par, key) if key else df.repartition(par)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table, spread over the cores when the file
    has too few splits (the DataFrame is reused, so the footer is read and the
    split count checked once per session)."""
    key = (id(spark), sf_dir, name, spark.conf.get("spark.tidemark.spread", "auto"))
    hit = _SCANS.get(key)
    if hit is None or hit[0] is not spark:  # ids can be reused by a new session
        hit = _SCANS[key] = (spark, spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), TABLE_KEYS.get(name)))
    return hit[1]


def register_tables(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Register driver tables as temp views (all, or just ``names``)."""
    for t in names or TABLES:
        reg, what = _REGISTERED.get((id(spark), t)), (sf_dir, spark.conf.get("spark.tidemark.spread", "auto"))
        if reg is None or reg[0] is not spark or reg[1] != what or not spark.catalog.tableExists(t):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
            _REGISTERED[(id(spark), t)] = (spark, what)


def tables_of(sql: str) -> list[str]:
    """Driver tables a view reads."""
    import re
    return [t for t in TABLES if re.search(rf"\bFROM\s+{t}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame (its tables registered on first use)."""
    register_tables(spark, sf_dir, tables_of(VIEWS[name]))
    return spark.sql(VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named views as CTEs (for the DuckDB oracle)."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    # `sql` may start with further CTEs (``name AS (...)``) before its SELECT
    sep = "\n" if sql.lstrip()[:6].upper() == "SELECT" else ",\n"
    return f"WITH {ctes}{sep}{sql}"
