"""Progress analytics over transfer events: A2, A7-A10, W1-W3, W6, W7, O2,
S11 log parsing, X14/X17/X18 helpers live in ``functions.columns``.

Per-run "latest" state uses ``max_by`` (partial aggregation; a hot run is
combined map-side).  Ordered per-feed computations (lags, running sums,
trailing frames) use :func:`~tidemark.operators.scan.ordered_scan`, which
splits a hot feed over many tasks instead of sorting it in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import _c, stage_percent
from ..schemas import ACTIVE_STAGES, STAGES
from ..sources.rejects import checked, reject_rows
from .scan import hot_pieces, join_null_safe, ordered_scan

NTZ_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(ts) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ wall clock, built from
    its date and time fields so no session time zone is involved."""
    c = _c(ts)
    day = F.unix_date(F.to_date(c)).cast("long")
    secs = F.hour(c).cast("long") * 3600 + F.minute(c).cast("long") * 60 + F.second(c).cast("long")
    micros = F.date_format(c, "SSSSSS").cast("long")
    return (day * 86400 + secs) * 1_000_000 + micros


def stage_ordinal(stage) -> Column:
    """Position of a stage in pending -> ... -> completed, failed."""
    out = None
    for i, s in enumerate(STAGES):
        out = (F.when(_c(stage) == s, F.lit(i)) if out is None else out.when(_c(stage) == s, F.lit(i)))
    return out


# --------------------------------------------------------------------------- W3, A2
def latest_progress(events: DataFrame, run: str = "run_id", order: tuple = ("ts", "event_id")) -> DataFrame:
    """The last event of each run (last write wins), by ``order``."""
    cols = [c for c in events.columns if c != run]
    key = F.struct(*[F.col(c) for c in order])
    agg = events.groupBy(run).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), key).alias("_last"))
    return agg.select(run, *[F.col(f"_last.{c}").alias(c) for c in cols])


def status_counts(latest: DataFrame, total=None, stage: str = "stage", ts: str | None = None,
                  as_of=None, stale_after: str | None = None) -> DataFrame:
    """A2: completed, failed, active (downloading + extracting + compressing)
    and queued = max(0, total - the others).  ``total`` is an int, a one-row
    DataFrame with column ``total``, or None (= number of rows).

    Optional stale-run timeout: with ``ts`` (time of the run's latest event),
    ``as_of`` (a timestamp literal or Column) and ``stale_after`` (e.g.
    ``"1 hour"``), an active run whose latest event is older than that is
    counted as ``stale`` instead of active -- the tool leaves runs that hit an
    error in ``downloading`` for ever."""
    s = F.col(stage)
    active = s.isin(*ACTIVE_STAGES)
    stale = F.lit(False)
    if ts and as_of is not None and stale_after:
        ref = as_of if isinstance(as_of, Column) else F.lit(as_of)
        cutoff = epoch_micros(ref) - F.lit(_interval_micros(stale_after))
        stale = active & (epoch_micros(ts) < cutoff)
    counts = latest.agg(F.count_if(s == "completed").alias("completed"),
                        F.count_if(s == "failed").alias("failed"),
                        F.count_if(active & ~stale).alias("active"),
                        F.count_if(stale).alias("stale"),
                        F.count(F.lit(1)).alias("_rows"))
    if total is None:
        counts = counts.withColumn("total", F.col("_rows"))
    elif isinstance(total, int):
        counts = counts.withColumn("total", F.lit(total).cast("long"))
    else:  # one-row frame: broadcast equi-join on a constant key
        t = total.select(F.col("total").cast("long").alias("total"), F.lit(1).alias("_one"))
        counts = counts.withColumn("_one", F.lit(1)).join(F.broadcast(t), "_one").drop("_one")
    queued = F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("completed") - F.col("failed")
                        - F.col("active") - F.col("stale"))
    cols = ["completed", "failed", "active", queued.alias("queued"), "total"]
    if ts and as_of is not None and stale_after:
        cols.insert(3, "stale")
    return counts.select(*cols)


# --------------------------------------------------------------------------- A7, A8
def stage_percents(stage, done, total) -> Column:
    """Percent of each stage implied by a run's current stage: stages before
    it are 100, the running one is capped at 99, later ones 0; completed is
    100 everywhere."""
    st = _c(stage)
    run = stage_percent(done, total, finished=F.lit(False))
    d = (F.when(st == "downloading", run).when(st.isin("extracting", "compressing", "completed"), F.lit(100.0))
         .when(st == "failed", run).otherwise(F.lit(0.0)))
    e = (F.when(st == "extracting", run).when(st.isin("compressing", "completed"), F.lit(100.0))
         .otherwise(F.lit(0.0)))
    c = F.when(st == "compressing", run).when(st == "completed", F.lit(100.0)).otherwise(F.lit(0.0))
    return F.struct(d.alias("download"), e.alias("extraction"), c.alias("compression"))


def progress_weights(bytes_1, bytes_2) -> Column:
    """Stage weights of a run: b, 3b, 3b with b = bytes of both mates
    (a missing mate 2 counts 0)."""
    b = (_c(bytes_1).cast("double") + F.coalesce(_c(bytes_2).cast("double"), F.lit(0.0)))
    return F.struct(b.alias("download"), (b * 3.0).alias("extraction"), (b * 3.0).alias("compression"))


def overall_percent(percents: Column, weights: Column, stage=None) -> Column:
    """Weighted mean of the stage percents; 0 when the weights sum to 0;
    a completed run is 100."""
    tw = weights["download"] + weights["extraction"] + weights["compression"]
    v = F.when(tw == 0, F.lit(0.0)).otherwise(
        (percents["download"] * weights["download"] + percents["extraction"] * weights["extraction"]
         + percents["compression"] * weights["compression"]) / tw)
    if stage is not None:
        v = F.when(_c(stage) == "completed", F.lit(100.0)).otherwise(v)
    return v


def global_progress(runs: DataFrame, total=None, percent: str = "percent", status: str = "status",
                    speed: str = "speed_mbps") -> DataFrame:
    """One row -- total = max(total, rows); completed; active (neither
    completed nor failed); percent = sum of clamped percents / total; speed =
    sum of speeds."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(percent)))
    rows = F.count(F.lit(1))
    tot = rows if total is None else F.greatest(F.lit(int(total)), rows)
    return runs.agg(
        tot.cast("long").alias("total"),
        F.count_if(F.col(status) == "Completed").alias("completed"),
        F.count_if((F.col(status) != "Completed") & (F.col(status) != "Failed")).alias("active"),
        F.when(tot > 0, F.sum(p) / tot).otherwise(F.lit(0.0)).alias("percent"),
        F.coalesce(F.sum(F.coalesce(F.col(speed), F.lit(0.0))), F.lit(0.0)).alias("speed_mbps"))


# --------------------------------------------------------------------------- A10
def failure_summary(results: DataFrame, error: str = "error", seq: str = "seq") -> DataFrame:
    """A10: failed of total and the first error in record order."""
    e = F.col(error)
    return results.agg(F.count_if(e.isNotNull()).alias("failed"), F.count(F.lit(1)).alias("total"),
                       F.min_by(e, F.when(e.isNotNull(), F.col(seq))).alias("first_error"))


# --------------------------------------------------------------------------- W1, W2
def _interval_micros(window: str) -> int:
    n, unit = window.split()
    mult = {"microsecond": 1, "millisecond": 1000, "second": 1_000_000, "minute": 60_000_000,
            "hour": 3_600_000_000, "day": 86_400_000_000}
    unit = unit.lower().rstrip("s")
    return int(float(n) * mult[unit])


def _sliding_speed_window(samples: DataFrame, feed: str, ts: str, bytes_: str, w_us: int, seq: str) -> DataFrame:
    """W1 with per-feed windows (used when no feed is hot)."""
    s = samples.withColumn("_us", epoch_micros(ts))
    by_feed = Window.partitionBy(feed).orderBy("_us", seq)
    s = s.withColumn("_drop", F.when(F.col(bytes_) < F.lag(bytes_).over(by_feed), 1).otherwise(0))
    s = s.withColumn("_epoch", F.sum("_drop").over(by_feed.rowsBetween(Window.unboundedPreceding, 0)))
    by_epoch = Window.partitionBy(feed, "_epoch").orderBy("_us", seq)
    # the range frame holds all samples of the current time; the oldest of the frame is the least in the total order
    frame = Window.partitionBy(feed, "_epoch").orderBy("_us").rangeBetween(-w_us, 0)
    s = s.withColumn("_at", F.row_number().over(by_epoch))
    point = F.struct(F.col("_us").alias("t"), F.col("_at").alias("at"), F.col(bytes_).alias("b"))
    s = s.withColumn("_first", F.min(point).over(frame)).withColumn("_prev", F.lag(point).over(by_epoch))
    base = F.when(F.col("_first.at") < F.col("_at"), F.col("_first")).otherwise(F.coalesce(F.col("_prev"), F.col("_first")))
    dt = (F.col("_us") - base["t"]) / F.lit(1e6)
    speed = F.when(dt > 0, (F.col(bytes_) - base["b"]).cast("double") / F.greatest(dt, F.lit(0.001))) \
        .otherwise(F.lit(0.0))
    return s.withColumn("speed_bps", speed).withColumn("epoch", F.col("_epoch").cast("long")) \
        .drop("_us", "_drop", "_epoch", "_first", "_at", "_prev")


def sliding_speed(samples: DataFrame, feed: str = "feed", ts: str = "ts", bytes_: str = "bytes",
                  window: str = "3 seconds", split: str | int = "auto", seq: str | None = None) -> DataFrame:
    """Trailing-window throughput of a live byte counter, per feed.

    A drop of the counter starts a new epoch (history is cleared).  The
    baseline is the oldest sample inside ``[ts - window, ts]`` of the same
    epoch, or the previous sample of the epoch when only the current one is
    inside.  speed = (b1 - b0) / max(dt, 1 ms) in bytes per second, 0 when
    dt <= 0.  Samples of equal timestamps follow ``seq``, or, without it, their counter
    (those equal in both are interchangeable).

    When a feed is hot (``split``, detected once by default) the ordered
    steps are two split :func:`ordered_scan` passes (a feed is cut over many
    tasks) and the trailing frame is found without a
    range window: each sample gets a probe at ``ts - window``; merged with the
    samples in time order (probes first on ties), a running count gives the
    number of samples before the probe, i.e. the index of the oldest sample
    in the frame (clamped to the epoch start), which an equi-join on
    (feed, index) resolves.
    """
    w_us = _interval_micros(window)
    if split == "auto":
        split = hot_pieces(samples, [feed])
    seq = seq or bytes_
    if not split:
        return _sliding_speed_window(samples, feed, ts, bytes_, w_us, seq)
    s = samples.withColumn("_us", epoch_micros(ts))
    # scan 1: previous sample and position within the feed
    s = ordered_scan(s, [feed], ["_us", seq], lags={"_pb": bytes_, "_pt": "_us"}, row_number="_i", split=split)
    s = s.withColumn("_drop", F.when(F.col(bytes_) < F.col("_pb"), 1).otherwise(0).cast("long"))
    # scan 2: samples and probes (ts - window) merged in time order, probes
    # first on ties: a sample's running drop count is its epoch; a probe's
    # running sample count is the number of feed samples before the frame.
    pts = s.select(feed, F.col("_us").alias("_t"), F.lit(1).alias("_k"), F.col("_i").alias("_ref"),
                   F.col("_drop").alias("_d"))
    prb = s.select(feed, (F.col("_us") - F.lit(w_us)).alias("_t"), F.lit(0).alias("_k"), F.col("_i").alias("_ref"),
                   F.lit(0).cast("long").alias("_d"))
    merged = ordered_scan(pts.unionByName(prb), [feed], ["_t", "_k", "_ref"],
                          sums={"_before": F.col("_k").cast("long"), "_epoch": F.col("_d")}, split=split)
    epochs = merged.where(F.col("_k") == 1).select(feed, F.col("_ref").alias("_i"), "_epoch")
    probes = merged.where(F.col("_k") == 0).select(feed, F.col("_ref").alias("_i"),
                                                   (F.col("_before") + 1).alias("_ff"))
    starts = epochs.groupBy(feed, "_epoch").agg(F.min("_i").alias("_e0"))
    s = join_null_safe(join_null_safe(join_null_safe(s, epochs, [feed, "_i"]), probes, [feed, "_i"]),
                       starts, [feed, "_epoch"])
    # oldest sample of the frame, clamped to the start of the epoch
    s = s.withColumn("_fi", F.greatest(F.col("_ff"), F.col("_e0")))
    firsts = s.select(feed, F.col("_i").alias("_fi"), F.col("_us").alias("_t0"), F.col(bytes_).alias("_b0"))
    s = join_null_safe(s, firsts, [feed, "_fi"])
    single = (F.col("_i") - F.col("_fi")) == 0
    prev_ok = (F.col("_drop") == 0) & F.col("_pt").isNotNull()
    bt = F.when(~single, F.col("_t0")).when(prev_ok, F.col("_pt")).otherwise(F.col("_us"))
    bb = F.when(~single, F.col("_b0")).when(prev_ok, F.col("_pb")).otherwise(F.col(bytes_))
    dt = (F.col("_us") - bt) / F.lit(1e6)
    speed = F.when(dt > 0, (F.col(bytes_) - bb).cast("double") / F.greatest(dt, F.lit(0.001))).otherwise(F.lit(0.0))
    return (s.withColumn("speed_bps", speed).withColumn("epoch", F.col("_epoch"))
            .drop("_us", "_pb", "_pt", "_drop", "_epoch", "_i", "_ff", "_e0", "_fi", "_t0", "_b0"))


def instant_speed(samples: DataFrame, feed: str = "feed", ts: str = "ts", bytes_: str = "bytes", split: str | int = "auto",
                  seq: str | None = None) -> DataFrame:
    """MiB/s since the previous sample of the feed:
    max(0, delta bytes) / 1024^2 / max(dt, 1e-6); null for the first sample.
    Samples of equal timestamps follow ``seq``, or, without it, their counter.
    (Hot-feed safe ordered scan.)"""
    s = ordered_scan(samples.withColumn("_us", epoch_micros(ts)), [feed], ["_us", seq or bytes_], split=split,
                     lags={"_pb": bytes_, "_pt": "_us"})
    dt = (F.col("_us") - F.col("_pt")) / F.lit(1e6)
    v = (F.greatest(F.lit(0).cast("long"), F.col(bytes_) - F.col("_pb")).cast("double") / F.lit(1024.0 * 1024.0)
         / F.greatest(dt, F.lit(1e-6)))
    return s.withColumn("speed_mbps", F.when(F.col("_pb").isNotNull(), v)).drop("_us", "_pb", "_pt")


# --------------------------------------------------------------------------- W6, W7
def stage_transitions(events: DataFrame, run: str = "run_id", stage: str = "stage", ts: str = "ts",
                      seq: str = "event_id") -> DataFrame:
    """Each stage change of a run with the time spent in the previous
    stage; a move backwards in pending -> downloading -> extracting ->
    compressing -> completed (or any move out of a final stage) is illegal.
    Repeated events of the same stage are not transitions.  (Two hot-run safe
    ordered scans: one finds the changes, one pairs each change with the
    previous one.)"""
    split = hot_pieces(events, [run])
    e = ordered_scan(events.withColumn("_us", epoch_micros(ts)), [run], ["_us", seq], lags={"_ps": stage},
                     split=split)
    chg = e.where(F.col("_ps").isNull() | (F.col("_ps") != F.col(stage)))
    chg = ordered_scan(chg, [run], ["_us", seq], lags={"from_stage": stage, "_from_us": "_us"}, split=split)
    o_from, o_to = stage_ordinal(F.col("from_stage")), stage_ordinal(F.col(stage))
    illegal = (F.col("from_stage").isin("completed", "failed")
               | ((F.col(stage) != "failed") & (o_to < o_from)))
    secs = (F.col("_us") - F.col("_from_us")) / F.lit(1e6)
    return chg.where(F.col("from_stage").isNotNull()).select(
        run, seq, F.col("from_stage"), F.col(stage).alias("to_stage"),
        secs.alias("seconds_in_from"), illegal.alias("illegal"))


def running_bytes(samples: DataFrame, key: str = "run_id", order: tuple = ("ts", "event_id"),
                  bytes_: str = "bytes") -> DataFrame:
    """Running total of bytes per key across all its files (the tool's
    callback restarts per file; this accumulates).  Hot-key safe."""
    return ordered_scan(samples, [key], list(order), sums={"running_bytes": F.col(bytes_)})


# --------------------------------------------------------------------------- S11, O2, F9
_LOG_RE = r"^\[([^\]]*)\] \[([A-Za-z]+)\] (.*)$"


def _log_reason(l: Column) -> Column:
    return F.when(~F.coalesce(l.rlike(_LOG_RE), F.lit(False)), F.lit("not a log line"))


def log_rejects(df: DataFrame, line: str = "line", source: str | None = None, line_no: str | None = None) -> DataFrame:
    """Lines that are no log lines, as (source, line_no, line, reason)."""
    return reject_rows(df, _log_reason(F.col(line)), F.col(source) if source else F.lit(None), F.col(line), F.col(line_no) if line_no else None)


def parse_log_lines(df: DataFrame, line: str = "line", mode: str = "quarantine") -> DataFrame:
    """``[YYYY-MM-DD HH:MM:SS.mmm] [LEVEL] message`` -> ts (timestamp
    without zone), level (upper case), message; lines that do not match get
    null fields (:func:`log_rejects` has them) or, with ``mode='fail'``, fail."""
    l = F.col(line)
    ok = l.rlike(_LOG_RE)
    ts = F.to_timestamp_ntz(F.regexp_extract(l, _LOG_RE, 1), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    return (checked(df, _log_reason(l), mode).withColumn("ts", F.when(ok, ts))
              .withColumn("level", F.when(ok, F.upper(F.regexp_extract(l, _LOG_RE, 2))))
              .withColumn("message", F.when(ok, F.regexp_extract(l, _LOG_RE, 3))))


def read_transfer_log(spark, path: str) -> DataFrame:
    """S11 source: transfer log files -> (file, line_no, ts, level, message)."""
    from ..sources.text import read_numbered_lines
    return parse_log_lines(read_numbered_lines(spark, path, line_sep="\n").withColumnRenamed("value", "line"))


def sort_by_path(df: DataFrame, path: str = "path") -> DataFrame:
    """O1: global order by path (range-partitioned sort)."""
    return df.orderBy(path)


def log_tail(df: DataFrame, n: int = 101, order: tuple = ("ts", "event_id")) -> DataFrame:
    """O2: the last ``n`` entries (top-k: each partition keeps n rows)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
