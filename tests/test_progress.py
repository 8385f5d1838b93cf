"""Progress analytics: reference counts, weighted percent, sliding speed
against a line-by-line replay of the status bar's algorithm."""

import random
from collections import deque
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions.columns import log_line
from tidemark.operators import progress as P


def test_status_counts_reference_cases(spark):
    df = spark.createDataFrame([("r1", "completed"), ("r2", "downloading"), ("r3", "failed"), ("r4", "pending")],
                               "run_id string, stage string")
    r = P.status_counts(df, 4).first()
    assert (r["completed"], r["failed"], r["active"], r["queued"]) == (1, 1, 1, 1)
    obs = spark.createDataFrame([("a", "completed"), ("b", "failed")], "run_id string, stage string")
    r = P.status_counts(obs, 3).first()
    assert (r["completed"], r["failed"], r["active"], r["queued"]) == (1, 1, 0, 1)
    r = P.status_counts(obs, 1).first()
    assert r["queued"] == 0


def test_overall_percent_formula(spark):
    # (100*1 + 100*3 + 50*3) / 7 = 78.571...
    df = spark.createDataFrame([(100.0, 100.0, 50.0, 1.0, 3.0, 3.0, "compressing"),
                                (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "pending"),
                                (10.0, 0.0, 0.0, 1.0, 3.0, 3.0, "completed")],
                               "d double, e double, c double, wd double, we double, wc double, stage string")
    pct = F.struct(F.col("d").alias("download"), F.col("e").alias("extraction"), F.col("c").alias("compression"))
    w = F.struct(F.col("wd").alias("download"), F.col("we").alias("extraction"), F.col("wc").alias("compression"))
    got = [round(r[0], 2) for r in df.select(P.overall_percent(pct, w, "stage")).collect()]
    assert got == [78.57, 0.0, 100.0]


def test_latest_progress_last_write_wins(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("r", t, 1, "downloading"), ("r", t, 2, "extracting"),
                                ("r", t - timedelta(seconds=1), 3, "completed")],
                               "run_id string, ts timestamp_ntz, event_id long, stage string")
    assert P.latest_progress(df).first()["stage"] == "extracting"


def _replay(samples, window_s):
    """The status bar's deque algorithm, sample by sample."""
    out, dq = [], deque()
    for t, b in samples:
        if dq and b < dq[-1][1]:
            dq.clear()
        dq.append((t, b))
        cutoff = t - window_s
        while dq and dq[0][0] < cutoff:
            if len(dq) <= 2:
                break
            dq.popleft()
        (t0, b0), (t1, b1) = dq[0], dq[-1]
        out.append((b1 - b0) / max(t1 - t0, 0.001) if t1 > t0 and b1 >= b0 else 0.0)
    return out


def test_sliding_speed_matches_replay(spark):
    rng = random.Random(7)
    rows, base = [], datetime(2024, 1, 1)
    for feed in ("a", "b", "c"):
        t, b = 0.0, 0
        for _ in range(400):
            t += rng.choice([0.1, 0.1, 0.25, 0.5, 1.0, 3.0, 4.0])
            b = 0 if rng.random() < 0.03 else b + rng.randint(0, 10_000)
            rows.append((feed, base + timedelta(microseconds=round(t * 1e6)), b))
    df = spark.createDataFrame(rows, "feed string, ts timestamp_ntz, bytes long")
    got = {}
    for r in P.sliding_speed(df, "feed", "ts", "bytes", "3 seconds").collect():
        got[(r["feed"], r["ts"])] = r["speed_bps"]
    for feed in ("a", "b", "c"):
        s = sorted((ts, b) for f, ts, b in rows if f == feed)
        secs = [((ts - base).total_seconds(), b) for ts, b in s]
        want = _replay(secs, 3.0)
        mine = [got[(feed, ts)] for ts, _ in s]
        assert all(abs(x - y) < 1e-6 * max(1.0, abs(y)) for x, y in zip(mine, want)), feed


def test_instant_speed(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("f", t, 0), ("f", t + timedelta(seconds=2), 4 << 20),
                                ("f", t + timedelta(seconds=3), 1 << 20)], "feed string, ts timestamp_ntz, bytes long")
    got = [r["speed_mbps"] for r in P.instant_speed(df, "feed", "ts", "bytes").orderBy("ts").collect()]
    assert got == [None, 2.0, 0.0]


def test_stage_transitions(spark):
    t = datetime(2024, 1, 1)
    rows = [("r", t, 1, "downloading"), ("r", t + timedelta(seconds=5), 2, "downloading"),
            ("r", t + timedelta(seconds=10), 3, "extracting"), ("r", t + timedelta(seconds=20), 4, "downloading"),
            ("r", t + timedelta(seconds=30), 5, "completed"), ("r", t + timedelta(seconds=40), 6, "failed")]
    df = spark.createDataFrame(rows, "run_id string, ts timestamp_ntz, event_id long, stage string")
    got = [(r["from_stage"], r["to_stage"], r["seconds_in_from"], r["illegal"])
           for r in P.stage_transitions(df).orderBy("event_id").collect()]
    assert got == [("downloading", "extracting", 10.0, False), ("extracting", "downloading", 10.0, True),
                   ("downloading", "completed", 10.0, False), ("completed", "failed", 10.0, True)]


def test_log_roundtrip_and_tail(spark):
    t = datetime(2024, 1, 1, 12, 0, 0, 123456)
    df = spark.createDataFrame([(i, t + timedelta(seconds=i), "warn" if i % 3 else "info", f"m{i}")
                                for i in range(300)], "event_id long, ts timestamp_ntz, level string, msg string")
    lines = df.select("event_id", log_line("ts", F.upper("level"), "msg").alias("line"))
    assert lines.first()["line"] == "[2024-01-01 12:00:00.123] [INFO] m0"
    parsed = P.parse_log_lines(lines)
    assert parsed.where(F.col("level").isNull()).count() == 0
    tail = P.log_tail(parsed, 101).collect()
    assert len(tail) == 101 and max(r["event_id"] for r in tail) == 299 and min(r["event_id"] for r in tail) == 199


def test_failure_summary_first_error_in_order(spark):
    df = spark.createDataFrame([(3, "late"), (1, None), (2, "first")], "seq long, error string")
    r = P.failure_summary(df).first()
    assert (r["failed"], r["total"], r["first_error"]) == (2, 3, "first")


def test_ordered_scan_split_equals_window(spark):
    from tidemark.operators.scan import ordered_scan
    rng = random.Random(3)
    # one hot key with most rows, a few small ones
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randint(0, 5)}", i, rng.randint(0, 100)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    kw = dict(sums={"rs": F.col("v")}, lags={"pv": "v", "pt": "t"}, row_number="rn")
    a = ordered_scan(df, ["k"], ["t"], split=16, **kw)
    b = ordered_scan(df, ["k"], ["t"], split=False, **kw)
    cols = ["k", "t", "rs", "pv", "pt", "rn"]
    assert sorted(tuple(r) for r in a.select(cols).collect()) == sorted(tuple(r) for r in b.select(cols).collect())


def test_ordered_scan_paths_agree_on_nulls_and_a_hot_key(spark):
    from tidemark.operators.scan import ordered_scan
    rng = random.Random(5)
    # one key of 90 % of the rows; null keys; a first stretch without any value
    rows = [("hot" if rng.random() < 0.9 else rng.choice([None, "a", "b"]), i,
             None if i < 1500 or rng.random() < 0.3 else rng.randint(0, 100)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    kw = dict(sums={"rs": F.col("v")}, lags={"pv": "v"}, row_number="rn")
    one, many = ([tuple(r) for r in ordered_scan(df, ["k"], ["t"], split=n, **kw).select("k", "t", "rs", "pv", "rn").collect()]
                 for n in (0, 16))
    assert sorted(one, key=str) == sorted(many, key=str)


def test_backoff_cost_paths_agree_on_null_keys(spark):
    from tidemark.plans.resume import backoff_cost
    rng = random.Random(6)
    rows = [(rng.choice([None, "f"]), rng.choice([None, 1, 2]), i, rng.choice(["stream", "range"]), rng.random() < 0.05)
            for i in range(600)]
    df = spark.createDataFrame(rows, "file_id string, chunk_id long, seq long, kind string, progressed boolean")
    got = {}
    for mode in ("never", "always"):
        spark.conf.set("spark.tidemark.scan.split", mode)
        try:
            got[mode] = sorted((tuple(r) for r in backoff_cost(df).collect()), key=str)
        finally:
            spark.conf.unset("spark.tidemark.scan.split")
    assert got["never"] == got["always"] and len(got["never"]) == 6


def test_sliding_speed_split_path_matches_replay(spark):
    spark.conf.set("spark.tidemark.scan.hotKeyRows", "10")
    try:
        test_sliding_speed_matches_replay(spark)
        test_stage_transitions(spark)
    finally:
        spark.conf.unset("spark.tidemark.scan.hotKeyRows")


def test_status_counts_stale_runs(spark):
    t = datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([("r1", "downloading", t - timedelta(hours=5)), ("r2", "downloading", t),
                                ("r3", "completed", t - timedelta(hours=9))],
                               "run_id string, stage string, ts timestamp_ntz")
    r = P.status_counts(df, 4, ts="ts", as_of=t, stale_after="1 hour").first()
    assert (r["completed"], r["failed"], r["active"], r["stale"], r["queued"]) == (1, 0, 1, 1, 1)


def test_ordered_scan_keeps_null_keys(spark):
    from tidemark.operators.scan import ordered_scan
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 1)], "k string, t long, v long")
    for split in (4, 0):
        got = sorted((r["k"] or "", r["t"], r["rs"]) for r in
                     ordered_scan(df, ["k"], ["t"], sums={"rs": F.col("v")}, split=split).collect())
        assert got == [("", 1, 5), ("", 2, 11), ("a", 1, 1)], split


def test_read_transfer_log_file(spark, tmp_path):
    p = tmp_path / "app.log"
    p.write_text("[2024-01-01 00:00:01.250] [INFO] started\n[2024-01-01 00:00:02.000] [ERROR] boom\n")
    got = [(r["line_no"], r["level"], r["message"]) for r in P.read_transfer_log(spark, str(p)).orderBy("line_no").collect()]
    assert got == [(1, "INFO", "started"), (2, "ERROR", "boom")]


def test_samples_of_equal_time_follow_their_sequence(spark):
    """Repeated timestamps: both ways of the scan against a loop over the samples in order."""
    import random
    from datetime import datetime, timedelta

    from tidemark.operators.progress import instant_speed, sliding_speed
    rnd, t, rows = random.Random(6), datetime(2024, 1, 1), []
    for feed in ("a", "b", None):
        at, count = 0, 0
        for i in range(120):
            at += rnd.choice([0, 0, 400_000, 1_000_000, 5_000_000])
            count = rnd.choice([count, count + 7, count + 100, 3])
            rows.append((feed, t + timedelta(microseconds=at), count, i))
    want, now = {}, {}
    for feed in ("a", "b", None):
        history, epoch, last = [], 0, None
        for f, ts, count, i in (r for r in rows if r[0] == feed):
            us = (ts - t) // timedelta(microseconds=1)
            now[feed, i] = None if last is None else round(max(0, count - last[1]) / 1048576 / max((us - last[0]) / 1e6, 1e-6), 6)
            if last and count < last[1]:
                history, epoch = [], epoch + 1
            inside = [p for p in history if p[0] >= us - 3_000_000]
            base = inside[0] if inside else (history[-1] if history else (us, count))
            dt = (us - base[0]) / 1e6
            want[feed, i] = (epoch, round((count - base[1]) / max(dt, 0.001), 6) if dt > 0 else 0.0)
            history.append((us, count))
            last = (us, count)
    df = spark.createDataFrame(rows, "feed string, ts timestamp_ntz, bytes long, seq long").repartition(5)
    for split in (0, 7):
        got = sliding_speed(df, split=split, seq="seq").collect()
        assert {(r["feed"], r["seq"]): (r["epoch"], round(r["speed_bps"], 6)) for r in got} == want
        got = instant_speed(df, split=split, seq="seq").collect()
        assert {(r["feed"], r["seq"]): None if r["speed_mbps"] is None else round(r["speed_mbps"], 6) for r in got} == now
        a, b = ([tuple(r) for r in sliding_speed(d, split=split).orderBy("feed", "ts", "bytes", "speed_bps").select("feed", "ts", "bytes", "speed_bps").collect()] for d in (df, df.repartition(2)))
        assert a == b  # without a sequence the counter decides
