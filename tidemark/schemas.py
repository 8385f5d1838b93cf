"""Fixed schemas and value lists of the transfer-metadata data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the archive's run-report format exactly.
# ---------------------------------------------------------------------------

# Run report columns, in the archive's order (49 text columns).
RUN_REPORT_COLUMNS = [
    "run_accession", "study_accession", "secondary_study_accession", "sample_accession",
    "secondary_sample_accession", "experiment_accession", "submission_accession", "tax_id",
    "scientific_name", "instrument_platform", "instrument_model", "library_name",
    "nominal_length", "library_layout", "library_strategy", "library_source",
    "library_selection", "read_count", "center_name", "first_public", "last_updated",
    "experiment_title", "study_title", "study_alias", "run_alias", "fastq_bytes", "fastq_md5",
    "fastq_ftp", "fastq_aspera", "fastq_galaxy", "submitted_bytes", "submitted_md5",
    "submitted_ftp", "submitted_aspera", "submitted_galaxy", "submitted_format", "sra_bytes",
    "sra_md5", "sra_ftp", "sra_aspera", "sra_galaxy", "sample_alias", "sample_title",
    "nominal_sdev", "first_created", "bam_ftp", "fastq_file_role", "submitted_file_role",
    "sra_file_role",
]

# Columns that default to the empty string when absent or empty.
RUN_REPORT_DEFAULT_EMPTY = ["fastq_bytes", "fastq_md5", "fastq_ftp", "sample_title"]

# Run stages in their natural order (snake case as serialised).
STAGES = ["pending", "downloading", "extracting", "compressing", "completed", "failed"]
ACTIVE_STAGES = ["downloading", "extracting", "compressing"]

# Submission template header.
SUBMISSION_COLUMNS = [
    "filename", "filetype", "assembly", "title", "library_strategy", "library_source",
    "library_selection", "library_layout", "platform", "instrument_model",
    "design_description", "s3_path",
]

# File extensions that may belong to one BLAST database volume.
VOLUME_EXTENSIONS = ["phr", "psq", "pin", "pog", "pni", "pnd", "psi", "psd", "aln", "freq"]

# Prefix of the checksum tool's own log files (``<prefix>*.log``; every
# operator that skips them takes the prefix as a parameter) and the default
# manifest name.
MD5_LOG_PREFIX = "transfer_md5"
MD5_LOG_SUFFIX = ".log"
DEFAULT_MANIFEST_NAME = "md5.txt"

# Human byte units (binary).
BYTE_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]

# Retry budgets and timing.
CHUNK_REQUEUE_BUDGET = 3          # a failed chunk is requeued this many times
INNER_RETRY_LIMIT = 20            # stream retries inside one chunk
INNER_BACKOFF_CAP_S = 30          # seconds
BAD_RANGE_RETRY_LIMIT = 10        # unexpected range responses
DEFAULT_CHUNK_BYTES = 200 * 1024 * 1024
SPEED_WINDOW = "3 seconds"
FASTQ_EXPANSION = 3.0             # FASTQ bytes per SRA byte
STAGE_CAP_PERCENT = 99.0          # running stages never show 100 before they end

# ---------------------------------------------------------------------------
# Struct types
# ---------------------------------------------------------------------------

U64 = T.DecimalType(20, 0)
U64_MAX = 18446744073709551615

STAGE_PROGRESS = T.StructType([
    T.StructField("bytes_done", T.LongType()),
    T.StructField("bytes_total", T.LongType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("percent", T.DoubleType()),
])

RUN_PROGRESS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("overall_percent", T.DoubleType()),
    T.StructField("download", STAGE_PROGRESS),
    T.StructField("extraction", STAGE_PROGRESS),
    T.StructField("compression", STAGE_PROGRESS),
])

PROGRESS_MAP = T.MapType(T.StringType(), RUN_PROGRESS)

VALIDATE_CONFIG = T.StructType([
    T.StructField("enabled", T.BooleanType()),
    T.StructField("tool", T.StringType()),
    T.StructField("dbtype", T.StringType()),
    T.StructField("max_retries", T.LongType()),
    T.StructField("retry_delay_seconds", T.LongType()),
])

CATALOG_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("s3_url", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("database_type", T.StringType()),
    T.StructField("exclude", T.StringType()),
    T.StructField("include", T.StringType()),
    T.StructField("validate", VALIDATE_CONFIG),
])

# Transfer event stream: a tagged union flattened into one nullable struct.
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("type", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("bytes_done", T.LongType()),
    T.StructField("bytes_total", T.LongType()),
    T.StructField("percent", T.DoubleType()),
    T.StructField("speed_mbps", T.DoubleType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("error", T.StringType()),
])

