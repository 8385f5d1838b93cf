"""Transfer planning tables: G1 file tasks, G2 chunk plan, G3 explodes,
J2-J5 and J9 decisions, A6 bytes already held, O3 backoff cost.

Nothing here moves bytes; these are the tables a scheduler would consume.
Joins are equi-joins on file/run keys (shuffle-hash or sort-merge chosen by
Catalyst, skew split by AQE); no per-row Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import hot_pieces, join_null_safe, ordered_scan
from ..schemas import BAD_RANGE_RETRY_LIMIT, CHUNK_REQUEUE_BUDGET, INNER_BACKOFF_CAP_S, INNER_RETRY_LIMIT

# Chunks planned per generator row before the plan is split across tasks.
CHUNKS_PER_BLOCK = 4096


def file_tasks(processed: DataFrame) -> DataFrame:
    """G1: one row per file to fetch.  Mate 1 always; mate 2 only when its url,
    md5, name **and** size are all present (stricter than the checksum TSV)."""
    m1 = F.struct(F.lit(1).alias("mate"), F.col("fastq_ftp_1_url").alias("url"),
                  F.col("fastq_md5_1").alias("md5"), F.col("fastq_ftp_1_name").alias("filename"),
                  F.col("fastq_bytes_1").alias("total_size"))
    m2 = F.struct(F.lit(2).alias("mate"), F.col("fastq_ftp_2_url").alias("url"),
                  F.col("fastq_md5_2").alias("md5"), F.col("fastq_ftp_2_name").alias("filename"),
                  F.col("fastq_bytes_2").alias("total_size"))
    ok = lambda t: (t["url"].isNotNull() & t["md5"].isNotNull() & t["filename"].isNotNull()
                    & t["total_size"].isNotNull())
    return (processed
            .select("run_accession", F.explode(F.filter(F.array(m1, m2), ok)).alias("t"))
            .select("run_accession", "t.*"))


def chunk_plan(files: DataFrame, chunk_bytes: int, file_id: str = "file_id",
               size: str = "size") -> DataFrame:
    """Inclusive byte ranges ``[i*c, min((i+1)*c-1, size-1)]`` for
    ``i < ceil(size/c)``; size 0 or null gives no chunk.

    A file of one block (:data:`CHUNKS_PER_BLOCK` chunks) gives its rows where
    it is.  A larger one is first cut into blocks and the block rows are spread
    over tasks before the chunks are generated, so one file never produces all of
    its rows in a single task.
    """
    c = int(chunk_bytes)
    if c <= 0:
        raise ValueError("chunk_bytes must be positive")
    staged = files.select(F.col(file_id).alias("file_id"), F.col(size).cast("long").alias("size")).where("size > 0")
    staged = staged.withColumn("_n", F.expr(f"(size - 1) div {c} + 1"))
    one = F.col("_n") <= CHUNKS_PER_BLOCK
    zero = F.lit(0).cast("long")
    small = staged.where(one).select("file_id", "size", F.explode(F.sequence(zero, F.col("_n") - 1)).alias("chunk_id"))
    nb = F.expr(f"(_n - 1) div {CHUNKS_PER_BLOCK}")
    blocks = staged.where(~one).select("file_id", "size", "_n", F.explode(F.sequence(zero, nb)).alias("_b")).repartition("file_id", "_b")
    lo = F.col("_b") * F.lit(CHUNKS_PER_BLOCK)
    hi = F.least(lo + F.lit(CHUNKS_PER_BLOCK), F.col("_n")) - 1
    chunks = small.unionByName(blocks.select("file_id", "size", F.explode(F.sequence(lo, hi)).alias("chunk_id")))
    return chunks.select(
        "file_id", "chunk_id",
        (F.col("chunk_id") * F.lit(c)).alias("start"),
        F.least((F.col("chunk_id") + 1) * F.lit(c) - 1, F.col("size") - 1).alias("end"),
    )


def finished_chunks(state: DataFrame, file_id: str = "file_id", chunk_id: str = "chunk_id") -> DataFrame:
    """Distinct finished (file, chunk) ids."""
    return state.select(F.col(file_id).alias("file_id"), F.col(chunk_id).cast("long").alias("chunk_id")) \
        .where(F.col("chunk_id").isNotNull()).dropDuplicates(["file_id", "chunk_id"])


def pending_chunks(plan: DataFrame, state: DataFrame) -> DataFrame:
    """Planned chunks minus finished ids (anti join on file and chunk)."""
    done = state.select("file_id", F.col("chunk_id").cast("long").alias("chunk_id"))
    return plan.join(done, ["file_id", "chunk_id"], "left_anti")


def resume_bytes(files: DataFrame, state: DataFrame, chunk_bytes: int) -> DataFrame:
    """Bytes already held per file = sum over distinct finished ids of
    ``max(0, min((id+1)*c, size) - id*c)``, capped at the file size.
    Files without state hold 0.

    The (possibly huge) chunk-id side is the streamed side of an inner join
    with the one-row-per-file sizes, so AQE can split a hot file; the sum is
    a partial aggregate; files without state are added by a left join of the
    per-file result (one row per file on both sides)."""
    c = int(chunk_bytes)
    sizes = files.select("file_id", F.col("size").cast("long").alias("size"))
    ids = finished_chunks(state)
    part = F.greatest(F.lit(0).cast("long"),
                      F.least((F.col("chunk_id") + 1) * F.lit(c), F.col("size")) - F.col("chunk_id") * F.lit(c))
    held = ids.join(sizes, "file_id").groupBy("file_id").agg(F.sum(part).alias("_held"))
    return (sizes.join(held, "file_id", "left")
            .select("file_id", "size", F.least(F.coalesce(F.col("_held"), F.lit(0).cast("long")), F.col("size"))
                    .alias("bytes_held")))


def resume_decision(remote: DataFrame, local: DataFrame, state: DataFrame) -> DataFrame:
    """Per remote file -- NEW when there is no local file; RESTART when the
    local size differs; VERIFY when sizes match and there is no chunk state;
    RESUME when sizes match and chunk state exists.  ``stale_state`` flags chunk
    state without a data file (those chunks would be skipped wrongly)."""
    has_state = state.groupBy("file_id").agg(F.count(F.lit(1)).alias("_n_state"))
    loc = local.groupBy("file_id").agg(F.max(F.col("local_size").cast("long")).alias("local_size"))
    j = (remote.select("file_id", F.col("size").cast("long").alias("size"))
         .join(loc, "file_id", "left").join(has_state, "file_id", "left"))
    st = F.col("_n_state").isNotNull()
    decision = (F.when(F.col("local_size").isNull(), F.lit("NEW"))
                .when(F.col("local_size") != F.col("size"), F.lit("RESTART"))
                .when(st, F.lit("RESUME"))
                .otherwise(F.lit("VERIFY")))
    return j.select("file_id", "size", "local_size", st.alias("has_state"), decision.alias("decision"),
                    (F.col("local_size").isNull() & st).alias("stale_state"))


def ftp_decision(tasks: DataFrame, local: DataFrame) -> DataFrame:
    """SKIP when the local file has the expected size (> 0) and md5;
    MISMATCH when the size is equal but the md5 differs (a continued fetch adds
    nothing and then fails the check); RESUME when a non-empty partial file
    exists; NEW otherwise."""
    # several copies of one name: the largest is the one that a fetch would go on with
    loc = (local.groupBy("filename").agg(F.max(F.struct(F.col("local_size").cast("long").alias("local_size"), "local_md5")).alias("_l"))
           .select("filename", "_l.local_size", "_l.local_md5"))
    j = tasks.join(loc, "filename", "left")
    size_eq = (F.col("local_size") == F.col("total_size").cast("long")) & (F.col("total_size") > 0)
    # the expected md5 is compared as given: an upper-case archive md5 fails
    md5_eq = F.col("local_md5") == F.col("md5")
    decision = (F.when(size_eq & F.coalesce(md5_eq, F.lit(False)), F.lit("SKIP"))
                .when(size_eq, F.lit("MISMATCH"))
                .when(F.col("local_size") > 0, F.lit("RESUME"))
                .otherwise(F.lit("NEW")))
    return j.withColumn("decision", decision)


def locate_runs(runs: DataFrame, locators: DataFrame, run: str = "run_id") -> DataFrame:
    """Attach the locator of each run; runs without one fail with
    ``No S3 URI``."""
    others = [c for c in locators.columns if c != run]
    # a run located twice keeps one locator, so that its row is not doubled
    one = locators.groupBy(run).agg(F.max(F.struct(*others)).alias("_l")).select(run, *[F.col(f"_l.{c}").alias(c) for c in others])
    j = runs.join(one, run, "left")
    return (j.withColumn("status", F.when(F.col("s3_uri").isNull(), F.lit("failed")).otherwise(F.lit("located")))
             .withColumn("error", F.when(F.col("s3_uri").isNull(), F.concat(F.lit("No S3 URI for "), F.col(run)))))


def has_fastq(runs: DataFrame, inventory: DataFrame, run: str = "run_id",
              filename: str = "filename", length: str = "length") -> DataFrame:
    """A run's conversion output is present when ``X_1.fastq`` or
    ``X.fastq`` exists and is non-empty (mate 2 alone does not count).

    Each non-empty ``*.fastq`` name yields the run ids it proves (``N.fastq``
    -> N; ``N_1.fastq`` -> N as well); the distinct ids are then equi-joined to
    the runs -- no pattern matching per (run, file) pair."""
    name = F.col(filename)
    single = F.regexp_replace(name, r"\.fastq$", "")
    mate1 = F.when(name.endswith("_1.fastq"), F.regexp_replace(name, r"_1\.fastq$", ""))
    present = (inventory.where((F.col(length) > 0) & name.endswith(".fastq"))
               .select(F.explode(F.array_compact(F.array(single, mate1))).alias(run))
               .distinct()
               .withColumn("has_fastq", F.lit(True)))
    return runs.join(present, run, "left").withColumn("has_fastq", F.coalesce(F.col("has_fastq"), F.lit(False)))


def chunk_retries(attempts: DataFrame, budget: int = CHUNK_REQUEUE_BUDGET,
                  order: list[str] | None = None) -> DataFrame:
    """W4 (per attempt): running failure number per (file, chunk); failures up
    to ``budget`` are requeued, the next one is fatal.  Hot-chunk safe."""
    order = order or ["seq"]
    fails = F.when(~F.col("ok"), 1).otherwise(0).cast("long")
    r = ordered_scan(attempts, ["file_id", "chunk_id"], order, sums={"failure_no": fails})
    action = (F.when(F.col("ok"), F.lit("done"))
              .when(F.col("failure_no") <= budget, F.lit("requeue"))
              .otherwise(F.lit("fatal")))
    return r.withColumn("action", action)


def chunk_retry_summary(attempts: DataFrame, budget: int = CHUNK_REQUEUE_BUDGET) -> DataFrame:
    """W4 (per chunk): failures, requeues, fatal -- a plain partial-aggregating
    group-by, safe for hot chunks."""
    fails = F.count_if(~F.col("ok"))
    return (attempts.groupBy("file_id", "chunk_id")
            .agg(fails.cast("long").alias("failures"), F.count_if(F.col("ok")).cast("long").alias("successes"))
            .withColumn("requeues", F.least(F.col("failures"), F.lit(budget).cast("long")))
            .withColumn("fatal", F.col("failures") > budget))


def backoff_sleep(kind: Column, k: Column) -> Column:
    """Sleep (seconds) before retry ``k``: stream errors wait
    min(30, 2^min(k,5)); unexpected range replies wait k seconds."""
    stream = F.least(F.lit(INNER_BACKOFF_CAP_S).cast("long"),
                     F.pow(F.lit(2.0), F.least(k, F.lit(5))).cast("long"))
    return F.when(kind == "range", k.cast("long")).otherwise(stream)


def backoff_cost(attempts: DataFrame, order: list[str] | None = None) -> DataFrame:
    """O3: per (file, chunk) total backoff seconds and whether the retry loop
    gave up.  ``attempts`` rows are failures with ``kind`` ('stream'|'range')
    and ``progressed`` (the stream moved forward before failing, which resets
    the shared retry counter).  Stream gives up after 20, range after 10.

    Segments between resets come from a running count of resets, k from a row
    number within (chunk, segment) -- both hot-chunk safe ordered scans; the
    first give-up per chunk is a ``min`` aggregate joined back, so rows after
    it are not charged."""
    order = order or ["seq"]
    keys = ["file_id", "chunk_id"]
    seg = F.when(F.col("progressed"), 1).otherwise(0).cast("long")
    split = hot_pieces(attempts, keys)
    staged = ordered_scan(attempts, keys, order, sums={"_seg": seg}, split=split)
    staged = ordered_scan(staged, keys + ["_seg"], order, row_number="k", split=split)
    give_up = ((F.col("kind") == "range") & (F.col("k") > BAD_RANGE_RETRY_LIMIT)) | \
              ((F.col("kind") != "range") & (F.col("k") > INNER_RETRY_LIMIT))
    pos = F.struct(*[F.col(c) for c in order])
    staged = staged.withColumn("_pos", pos)
    if split:
        # first give-up per chunk as a (partial) aggregate joined back
        first = staged.groupBy(*keys).agg(F.min(F.when(give_up, F.col("_pos"))).alias("_gu"))
        j = join_null_safe(staged, first, keys)
        live = F.col("_gu").isNull() | (F.col("_pos") < F.col("_gu"))
        dead = F.col("_gu").isNotNull()
    else:
        # same partitioning as the scans above: a running "given up yet" flag
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        j = staged.withColumn("_gu_before", F.coalesce(F.max(give_up.cast("int")).over(w), F.lit(0)))
        j = j.withColumn("_gu_here", give_up.cast("int"))
        live = (F.col("_gu_before") == 0) & (F.col("_gu_here") == 0)
        dead = (F.col("_gu_before") + F.col("_gu_here")) > 0
    return (j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("failures"),
        F.coalesce(F.sum(F.when(live, backoff_sleep(F.col("kind"), F.col("k")))), F.lit(0)).cast("long")
        .alias("sleep_s"),
        F.max(dead).alias("gave_up")))


# --------------------------------------------------------------------------- G3
def explode_progress(df: DataFrame, json_col: str = "json") -> DataFrame:
    """A progress map (one JSON object keyed by run) -> one row per run."""
    from ..sources.state import parse_progress
    return parse_progress(df, json_col)


def explode_uris(failures: DataFrame, uris: str = "uris") -> DataFrame:
    """One row per uri of each failure, its place in the list kept; a failure
    without uris keeps one row with a null uri."""
    others = [c for c in failures.columns if c != uris]
    return failures.select(*others, F.posexplode_outer(uris).alias("pos", "uri"))
