"""Database catalogue x object listing: J6 match, J7 lookup, A3 volumes,
A4 validation roll-up, A5 missing parts, A11 failed volumes, W5 attempts.

The catalogue is a configuration table (tens of entries).  It is broadcast
only after its row count is checked against :data:`MAX_BROADCAST_ROWS`;
beyond that the match falls back to a shuffle join on the bucket, where AQE
splits a dominant bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import basename, etag_md5, file_extension, file_stem, s3_parse, wildcard_keep
from ..schemas import VOLUME_EXTENSIONS
from .scan import ordered_scan

MAX_BROADCAST_ROWS = 10_000


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when it provably has at most ``max_rows`` rows (a cheap
    ``limit`` count that stops early); otherwise return it unchanged."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def catalog_locations(catalog: DataFrame) -> DataFrame:
    """Catalogue rows with the parsed bucket and prefix of ``s3_url``."""
    loc = s3_parse("s3_url")
    return catalog.withColumn("_loc", loc).select(
        "*", F.col("_loc.bucket").alias("cat_bucket"), F.col("_loc.key").alias("cat_prefix"),
        F.col("_loc.error").alias("url_error")).drop("_loc")


def match_catalog(catalog: DataFrame, listing: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS,
                  max_literal_entries: int = 256) -> DataFrame:
    """Objects of each catalogue entry.

    Equi-join on (bucket, prefix): an object's key is cut at each length that a
    prefix of its bucket's entries has, so only true matches are paired; the
    listing clean-up (no key / no size / directory markers dropped) and the
    entry's own exclude/include wildcards are applied per row.  For a
    catalogue of up to ``max_literal_entries`` entries the wildcards become
    literal per-entry predicates (each pattern compiled once per task instead
    of once per row); larger catalogues use the pattern columns.
    """
    cat = catalog_locations(catalog).where(F.col("url_error").isNull()) \
        .select("name", "cat_bucket", "cat_prefix", "exclude", "include")
    entries = cat.select("name", "exclude", "include").limit(max_literal_entries + 1).collect()
    # the collected entries already prove the size bound when they all fit
    cat = F.broadcast(cat) if len(entries) <= max_literal_entries else bounded_broadcast(cat, max_broadcast_rows)
    lst = listing.where(F.col("key").isNotNull() & F.col("size").isNotNull()
                        & ~(F.col("key").endswith("/") & (F.col("size") == 0)))
    # at most as many lengths as an object key has characters
    lengths = sorted(r[0] for r in cat.select(F.length("cat_prefix")).distinct().collect() if r[0] is not None)
    cuts = F.array(*[F.when(F.length("key") >= n, F.substring("key", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    lst = lst.withColumn("_cut", F.explode(F.filter(cuts, lambda c: c.isNotNull())))
    j = lst.join(cat, (lst["bucket"] == cat["cat_bucket"]) & (lst["_cut"] == cat["cat_prefix"])).drop("_cut")
    rel = F.expr("substring(key, length(cat_prefix) + 1)")
    j = j.withColumn("rel_key", rel)
    names_unique = len({e["name"] for e in entries}) == len(entries)
    if len(entries) <= max_literal_entries and names_unique:
        keep = None
        for e in entries:
            k = wildcard_keep("rel_key", e["exclude"], e["include"])
            keep = F.when(F.col("name").eqNullSafe(e["name"]), k) if keep is None else keep.when(F.col("name").eqNullSafe(e["name"]), k)
        keep = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(False)
    else:
        keep = wildcard_keep("rel_key", F.col("exclude"), F.col("include"))
    return j.where(keep).select("name", "bucket", "key", "rel_key", "size", etag_md5("etag").alias("md5"))


def known_names(catalog: DataFrame) -> DataFrame:
    """The names that :func:`lookup_catalog` knows, sorted."""
    return catalog.select("name").where(F.col("name").isNotNull()).distinct().orderBy("name")


def lookup_catalog(catalog: DataFrame, requests: DataFrame, name: str = "name", list_names: bool = False) -> DataFrame:
    """Resolve requested names (an entry listed twice resolves to the one with
    the smallest url); an unknown name gets an error with the number of known ones
    or, with ``list_names``, all of them in sorted order, however many there are
    (:func:`known_names` has them as rows)."""
    cat = bounded_broadcast(catalog.groupBy(F.col("name").alias(name)).agg(F.min(F.struct("s3_url", "database_type")).alias("_e"))
                            .select(name, "_e.s3_url", "_e.database_type"))
    names = catalog.select("name").where(F.col("name").isNotNull()).distinct()
    known = F.array_join(F.sort_array(F.collect_list("name")), ", ") if list_names else F.format_string("%d databases", F.count("name"))
    j = requests.join(cat, name, "left").crossJoin(F.broadcast(names.agg(known.alias("_known"))))  # one row
    err = F.when(F.col("s3_url").isNull(), F.concat(F.lit("Unknown database '"), F.col(name), F.lit("'. Available: "), F.col("_known")))
    return j.withColumn("found", F.col("s3_url").isNotNull()).withColumn("error", err).drop("_known")


def volume_objects(objects: DataFrame, key: str = "key") -> DataFrame:
    """A3 (long form): every object with its volume (file stem of the name)."""
    return objects.withColumn("volume", file_stem(basename(F.col(key))))


def volumes(objects: DataFrame, key: str = "key", size: str = "size") -> DataFrame:
    """A3: volumes with object count, bytes and first/last key.  The member
    list stays in long form (:func:`volume_objects`) so a huge volume is never
    gathered into one row."""
    return (volume_objects(objects, key).groupBy("volume")
            .agg(F.count(F.lit(1)).alias("n_objects"), F.sum(size).alias("total_bytes"),
                 F.min(key).alias("first_key"), F.max(key).alias("last_key")))


def missing_parts(objects: DataFrame, extensions: Sequence[str] = VOLUME_EXTENSIONS,
                  key: str = "key") -> DataFrame:
    """A5: (volume, extension) pairs of the expected set that are absent.

    Each distinct volume is expanded by the fixed extension list (a generator,
    bounded by the list) and anti-joined with the present pairs."""
    present = objects.select(file_stem(basename(F.col(key))).alias("volume"),
                             file_extension(F.col(key)).alias("extension")).distinct()
    expected = (present.select("volume").distinct()
                .select("volume", F.explode(F.array(*[F.lit(e) for e in extensions])).alias("extension")))
    return expected.join(present, ["volume", "extension"], "left_anti")


def volume_attempts(outcomes: DataFrame, max_retries: int = 2, keys: Sequence[str] = ("volume", "batch"),
                    order: Sequence[str] = ("attempt",)) -> DataFrame:
    """Result of each volume download given its validation outcomes in
    order.  ``valid`` ends with success; ``tool_error`` is fatal at once; the
    (max_retries+1)-th ``corrupted`` is fatal.  Outcomes after the first
    terminal one are ignored.  Terminal candidates are found with one window
    (rank among corrupted results, a hot-key safe ordered scan) and reduced
    with ``min_by`` (partial aggregation)."""
    keys = list(keys)
    max_attempts = max_retries + 1
    staged = ordered_scan(outcomes.withColumn("_is_c", F.col("outcome") == "corrupted"), keys + ["_is_c"],
                          list(order), row_number="_rank")
    terminal = ((F.col("outcome") == "valid") | (F.col("outcome") == "tool_error")
                | ((F.col("outcome") == "corrupted") & (F.col("_rank") == max_attempts)))
    pos = F.struct(*[F.col(c) for c in order])
    cand = staged.withColumn("_term", terminal)
    res = cand.groupBy(*keys).agg(
        F.min_by(F.col("outcome"), F.when(F.col("_term"), pos)).alias("_final"),
        F.count_if(F.col("outcome") == "corrupted").alias("_n_corrupt"),
    )
    # corrupted results that happened before the terminal one
    status = (F.when(F.col("_final") == "valid", F.lit("validated"))
              .when(F.col("_final").isNull(), F.lit("incomplete"))
              .otherwise(F.lit("failed")))
    error = (F.when(F.col("_final") == "tool_error",
                    F.concat(F.lit("Volume "), F.col(keys[0]), F.lit(" validation command failed")))
             .when(F.col("_final") == "corrupted",
                   F.concat(F.lit("Volume "), F.col(keys[0]),
                            F.lit(f" failed validation after {max_retries} retries"))))
    return res.select(*keys, status.alias("status"), error.alias("error"))


def volume_validation(files: DataFrame, outcomes: DataFrame, directory: str, path: str = "key") -> DataFrame:
    """A4: validation roll-up of one directory: only ``.phr`` files directly in
    ``directory`` define volumes; failed = corrupted + tool errors.  Returns one
    row (passed, failed)."""
    d = directory if directory.endswith("/") else directory + "/"
    p = F.col(path)
    rel = F.expr(f"substring({path}, {len(d) + 1})")
    vols = (files.where(p.startswith(d)).withColumn("_rel", rel)
            .where(~F.col("_rel").contains("/") & F.col("_rel").endswith(".phr"))
            .select(file_stem(F.col("_rel")).alias("volume")).distinct())
    j = vols.join(outcomes.select("volume", "outcome"), "volume", "left")
    return j.agg(F.count_if(F.col("outcome") == "valid").alias("passed"),
                 F.count_if(F.col("outcome").isNull() | (F.col("outcome") != "valid")).alias("failed"))


def failed_volumes(results: DataFrame, objects: DataFrame, bucket_col: str = "bucket",
                   order_col: str | None = None) -> DataFrame:
    """Failed volumes in long form -- (volume, error, uri) per object.

    Results are first reduced to one row per failed volume (the first error by
    ``order_col``, partial aggregation), then the objects join on the stem, so
    the output is one row per object of a failed volume -- never failed
    attempts x objects, and the uri list is never gathered into one row."""
    failed = results.where(F.col("status") == "failed")
    first = F.min_by("error", order_col) if order_col else F.min("error")
    failed = failed.groupBy("volume").agg(first.alias("error"))
    objs = volume_objects(objects).select(
        "volume", F.concat(F.lit("s3://"), F.col(bucket_col), F.lit("/"), F.col("key")).alias("uri"))
    # objects stream through an inner join (AQE can split a hot volume);
    # failed volumes without objects are added back with a null uri
    with_objs = objs.join(failed, "volume").select("volume", "error", "uri")
    without = failed.join(objs.select("volume"), "volume", "left_anti") \
        .select("volume", "error", F.lit(None).cast("string").alias("uri"))
    return with_objs.unionByName(without)
