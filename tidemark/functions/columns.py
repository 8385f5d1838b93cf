"""Column functions (``Column -> Column``), all built from Catalyst expressions.

Everything here stays inside whole-stage codegen: no Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BYTE_UNITS, U64, U64_MAX


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fail_if(df, cond: Column, message: Column):
    """Fail the job on the first row where ``cond`` holds, with ``message``.

    Expressed as a filter so the check cannot be pruned away: the predicate is
    true for good rows and raises for bad ones."""
    return df.where(F.when(cond, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def trim_ws(c) -> Column:
    """Trim leading and trailing whitespace of any kind (tabs, CR, Unicode
    spaces), as the archive tool's string trim does; ``trim`` only strips
    spaces."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


# --------------------------------------------------------------------------- X1, X2
def packed_list(c) -> Column:
    """Split a ``;``-packed cell, drop empty items, no trimming."""
    return F.filter(F.split(F.coalesce(_c(c), F.lit("")), ";"), lambda x: x != "")


def _u64_or_null(x: Column) -> Column:
    ok = x.rlike(r"^\+?[0-9]+$")
    v = F.when(ok, F.regexp_replace(x, r"^\+", "").try_cast(U64))
    return F.when(v <= F.lit(str(U64_MAX)).cast(U64), v)


def size_list(c, aligned: bool = False) -> Column:
    """Parse a ``;``-packed list of unsigned 64-bit sizes.

    Items that are not plain unsigned integers (or exceed 2^64-1) are dropped,
    so later sizes shift left -- the archive tool's behaviour.  ``aligned=True``
    keeps a null in their place instead.
    """
    vals = F.transform(F.split(F.coalesce(_c(c), F.lit("")), ";"), _u64_or_null)
    return vals if aligned else F.filter(vals, lambda x: x.isNotNull())


# --------------------------------------------------------------------------- F4, F5
def has_items(c, n: int = 1) -> Column:
    """True when the ``;``-packed cell has at least ``n`` (1 or 2) non-empty
    items -- the same answer as ``size(packed_list(c)) >= n`` without building
    the array (a plain regex, cheap enough to push into the scan)."""
    v = F.coalesce(_c(c), F.lit(""))
    if n == 1:
        return v.rlike("[^;]")
    if n == 2:
        return v.rlike("[^;];+[^;]")
    return F.size(packed_list(c)) >= n


def downloadable(urls, md5s) -> Column:
    """at least one url and one md5 after dropping blanks."""
    return has_items(urls) & has_items(md5s)


def is_paired(urls) -> Column:
    """two or more urls (the layout column is not consulted)."""
    return has_items(urls, 2)


# --------------------------------------------------------------------------- X4, X9, X13
def basename(c) -> Column:
    """Text after the last ``/``; the whole string when there is none."""
    return F.substring_index(_c(c), "/", -1)


def file_stem(c) -> Column:
    """File name without its last suffix; leading-dot names stay whole."""
    name = basename(c)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def file_extension(c) -> Column:
    """Last suffix of a file name without the dot (null when none)."""
    name = basename(c)
    return F.when(name.rlike(r".\.[^.]*$"), F.regexp_extract(name, r"\.([^.]*)$", 1))


def target_name(s3_uri, run) -> Column:
    """Last segment of the s3 uri, or the run id when that is empty."""
    return F.coalesce(F.nullif(F.substring_index(_c(s3_uri), "/", -1), F.lit("")), _c(run))


# --------------------------------------------------------------------------- X5-X8, X10
def s3_parse(c) -> Column:
    """``s3://bucket/key`` -> struct(bucket, key, error).

    The value is trimmed; no ``/`` after the bucket gives key ``''``.  Invalid
    input yields null bucket/key and an error text.
    """
    v = trim_ws(c)
    rest = F.when(v.startswith("s3://"), F.substring(v, 6, 1 << 30))
    has_slash = F.instr(rest, "/") > 0
    bucket = F.when(has_slash, F.substring_index(rest, "/", 1)).otherwise(rest)
    key = F.when(has_slash, rest.substr(F.instr(rest, "/") + 1, F.lit(1 << 30))).otherwise(F.lit(""))
    error = (F.when(v.isNull(), F.lit("null url"))
             .when(~v.startswith("s3://"), F.lit("not an s3 url"))
             .when(bucket == "", F.lit("missing bucket"))
             .when(bucket.contains("?") | bucket.contains("#"), F.lit("invalid bucket")))
    ok = error.isNull()
    return F.struct(F.when(ok, bucket).alias("bucket"), F.when(ok, key).alias("key"),
                    error.alias("error"))


# Characters that a URL path setter leaves as they are although
# Java's URLEncoder escapes them (escape, character), in code-point order.
_PATH_KEEP = [
    ("%21", "!"), ("%24", "$"), ("%26", "&"), ("%27", "'"), ("%28", "("), ("%29", ")"),
    ("%2B", "+"), ("%2C", ","), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@"),
    ("%5B", "["), ("%5C", "/"), ("%5D", "]"), ("%5E", "^"), ("%7C", "|"), ("%7E", "~"),
]


def path_encode(segment: Column) -> Column:
    """Percent-encode one path segment the way a URL path setter does.

    Encoded: controls, space, ``" # < > ? ` { }`` and non-ASCII bytes; ``%`` is
    kept as is; a backslash becomes ``/``.
    """
    e = F.replace(F.url_encode(segment), F.lit("+"), F.lit("%20"))
    for esc, ch in _PATH_KEEP:
        e = F.replace(e, F.lit(esc), F.lit(ch))
    return F.replace(e, F.lit("%25"), F.lit("%"))


def s3_to_https(bucket, key) -> Column:
    """Anonymous virtual-hosted HTTPS url of an object, path percent-encoded."""
    k = F.regexp_replace(F.coalesce(_c(key), F.lit("")), "^/+", "")
    enc = F.array_join(F.transform(F.split(k, "/"), path_encode), "/")
    return F.concat(F.lit("https://"), _c(bucket), F.lit(".s3.amazonaws.com/"), enc)


def resolve_url_pair(c) -> Column:
    """struct(s3_uri, http_url) from either form; null when neither matches."""
    v = _c(c)
    https_m = v.rlike(r"^https://.*?\.s3\.amazonaws\.com/")
    hb = F.regexp_extract(v, r"^https://(.*?)\.s3\.amazonaws\.com/(.*)$", 1)
    hk = F.regexp_extract(v, r"^https://(.*?)\.s3\.amazonaws\.com/(.*)$", 2)
    s3_m = v.rlike(r"^s3://[^/]*/")
    sb = F.regexp_extract(v, r"^s3://([^/]*)/(.*)$", 1)
    sk = F.regexp_extract(v, r"^s3://([^/]*)/(.*)$", 2)
    s3_uri = (F.when(https_m, F.concat(F.lit("s3://"), hb, F.lit("/"), hk))
              .when(s3_m, v))
    http = (F.when(https_m, v)
            .when(s3_m, F.concat(F.lit("https://"), sb, F.lit(".s3.amazonaws.com/"), sk)))
    return F.when(s3_uri.isNotNull(), F.struct(s3_uri.alias("s3_uri"), http.alias("http_url")))


def etag_md5(c) -> Column:
    """ETag -> lower-case md5; multipart or malformed tags give null."""
    v = F.btrim(_c(c), F.lit('"'))
    return F.when(v.rlike("^[0-9A-Fa-f]{32}$"), F.lower(v))


def relative_key(key, prefix) -> Column:
    """Strip ``prefix`` from ``key`` when it starts with it."""
    k, p = _c(key), _c(prefix)
    return F.when(k.startswith(p), k.substr(F.length(p) + 1, F.lit(1 << 30))).otherwise(k)


def wildcard_to_like(pattern: str) -> str:
    """Translate a shell wildcard (``*`` any run incl. ``/``, ``?`` one char)
    into a LIKE pattern with ``!`` as the escape character."""
    out = []
    for ch in pattern:
        if ch == "*":
            out.append("%")
        elif ch == "?":
            out.append("_")
        elif ch in "%_!":
            out.append("!" + ch)
        else:
            out.append(ch)
    return "".join(out)


def wildcard_like_col(pattern_col) -> Column:
    """Same translation as :func:`wildcard_to_like` for a pattern column."""
    p = _c(pattern_col)
    p = F.replace(p, F.lit("!"), F.lit("!!"))
    p = F.replace(p, F.lit("%"), F.lit("!%"))
    p = F.replace(p, F.lit("_"), F.lit("!_"))
    p = F.replace(p, F.lit("*"), F.lit("%"))
    return F.replace(p, F.lit("?"), F.lit("_"))


def canonical_path(path) -> Column:
    """A path without empty, ``.`` and ``..`` components (links are not followed): ``a/../b`` is ``b``,
    ``/..`` is ``/``, and a relative path keeps the ``..`` that lead out of it."""
    p = _c(path)
    rooted = p.startswith("/")

    def step(done: Column, part: Column) -> Column:
        back = F.when((F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)) \
            .when(rooted, done).otherwise(F.concat(done, F.array(part)))
        return F.when(part.isin("", "."), done).when(part == "..", back).otherwise(F.concat(done, F.array(part)))

    folded = F.array_join(F.aggregate(F.split(p, "/", -1), F.array().cast("array<string>"), step), "/")
    whole = F.when(rooted, F.concat(F.lit("/"), folded)).when(folded == "", F.lit(".")).otherwise(folded)
    # most paths are plain already
    return F.when(p.rlike(r"//|(?:^|/)\.\.?(?:/|$)|./$"), whole).otherwise(p)


def wildcard_match(key, pattern) -> Column:
    """True when ``key`` matches the wildcard ``pattern`` (False when pattern is null).

    ``pattern`` is a python string (compiled once) or a Column with one pattern
    per row (for catalogue joins).
    """
    k = _c(key)
    if pattern is None:
        return F.lit(False)
    if isinstance(pattern, str):
        return F.like(k, F.lit(wildcard_to_like(pattern)), F.lit("!"))
    p = _c(pattern)
    return F.coalesce(F.like(k, wildcard_like_col(p), F.lit("!")), F.lit(False))


def wildcard_keep(key, exclude=None, include=None) -> Column:
    """an include match keeps the key even if excluded; otherwise keep
    unless excluded.  An include pattern alone restricts nothing."""
    return wildcard_match(key, include) | ~wildcard_match(key, exclude)


# --------------------------------------------------------------------------- X11, X12
def file_type(c) -> Column:
    """X11: submission file type from the suffix (fastq by default)."""
    n = _c(c)
    return (F.when(n.endswith(".fastq.gz") | n.endswith(".fq.gz"), F.lit("fastq"))
            .when(n.endswith(".bam"), F.lit("bam"))
            .when(n.endswith(".cram"), F.lit("cram"))
            .when(n.endswith(".vcf") | n.endswith(".vcf.gz"), F.lit("vcf"))
            .otherwise(F.lit("fastq")))


def upload_key(prefix, name) -> Column:
    """Object key = prefix without trailing ``/`` + ``/`` + name; no prefix -> name."""
    p = _c(prefix)
    return F.when(p.isNull(), _c(name)).otherwise(
        F.concat(F.regexp_replace(p, "/+$", ""), F.lit("/"), _c(name)))


def upload_uri(bucket, prefix, name) -> Column:
    """``s3://bucket/<upload key>``."""
    return F.concat(F.lit("s3://"), _c(bucket), F.lit("/"), upload_key(prefix, name))


# --------------------------------------------------------------------------- X14, X17, X18
def human_bytes(c) -> Column:
    """Binary units with one decimal.

    ``0 B``; plain integer below 1024; otherwise value / 1024^k (k = largest
    unit reached, PiB at most) rounded half-even on the exact quotient, done
    in exact decimal arithmetic so 2.25 shows as 2.2.
    """
    raw = _c(c).cast("decimal(38,0)")
    out = F.when(raw == 0, F.lit("0 B")).when(raw < 1024, F.concat(raw.cast("string"), F.lit(" B")))
    top = len(BYTE_UNITS) - 1
    for i in range(1, len(BYTE_UNITS)):
        d = F.lit(1024 ** i).cast("decimal(38,0)")
        cond = raw >= d if i == top else (raw >= d) & (raw < F.lit(1024 ** (i + 1)).cast("decimal(38,0)"))
        tenfold = raw * F.lit(10).cast("decimal(38,0)")
        q = F.floor(tenfold / d).cast("decimal(38,0)")
        r2 = (tenfold - q * d) * F.lit(2).cast("decimal(38,0)")
        q = (F.when(r2 > d, q + 1)
             .when((r2 == d) & (F.pmod(q, F.lit(2)) == 1), q + 1)
             .otherwise(q))
        txt = F.concat(F.floor(q / 10).cast("string"), F.lit("."), F.pmod(q, F.lit(10)).cast("string"),
                       F.lit(" " + BYTE_UNITS[i]))
        out = out.when(cond, txt)
    return out


def log_line(ts, level, msg) -> Column:
    """``[YYYY-MM-DD HH:MM:SS.mmm] [LEVEL] message`` (level upper-cased)."""
    return F.format_string("[%s] [%s] %s", F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss.SSS"),
                           F.upper(_c(level)), _c(msg))


def file_stamp(ts) -> Column:
    """Clock stamp used in output file names, ``YYYY-MM-DD_HH-MM-SS``
    (the timestamp is passed in, so a re-run gives the same names)."""
    return F.date_format(_c(ts), "yyyy-MM-dd_HH-mm-ss")


def header_stamp(ts) -> Column:
    """Clock stamp of manifest headers, ``YYYY-MM-DD HH:MM:SS``."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


def output_paths(accession) -> Column:
    """Where the files of an accession go below the output folder, as a struct:
    the report's folder and name, and the checksum lists of both mates."""
    a = _c(accession)
    return F.struct(F.concat(a, F.lit("_metadata")).alias("folder"), F.concat(F.lit("ena_metadata_"), a, F.lit(".tsv")).alias("report"),
                    F.concat(F.lit("R1_fastq_md5_"), a, F.lit(".tsv")).alias("mate_1"),
                    F.concat(F.lit("R2_fastq_md5_"), a, F.lit(".tsv")).alias("mate_2"))


def avg_speed_mb_s(bytes_, seconds) -> Column:
    """MiB per second; elapsed time floored at 1 ms."""
    return (_c(bytes_).cast("double") / F.lit(1024.0 * 1024.0)) / F.greatest(
        _c(seconds).cast("double"), F.lit(0.001))


avg_speed = avg_speed_mb_s  # X18 name used in the operator inventory


def size_gb(bytes_) -> Column:
    """Bytes as GiB (double)."""
    return _c(bytes_).cast("double") / F.lit(1024.0 ** 3)


def size_mb(bytes_) -> Column:
    """Bytes as MiB (double)."""
    return _c(bytes_).cast("double") / F.lit(1024.0 ** 2)


# --------------------------------------------------------------------------- A7
def stage_percent(done, total, finished=None) -> Column:
    """min(100, done/total*100), 0 when total is 0; capped at 99 until the
    stage is finished (``finished`` is a boolean Column; None means no cap)."""
    d, t = _c(done).cast("double"), _c(total).cast("double")
    p = F.when(t > 0, F.least(d / t * F.lit(100.0), F.lit(100.0))).otherwise(F.lit(0.0))
    if finished is None:
        return p
    return F.when(_c(finished), F.lit(100.0)).otherwise(F.least(p, F.lit(99.0)))
