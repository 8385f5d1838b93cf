"""Streams equal their batch twins; re-runs are idempotent; late rows are
dropped and counted."""

import os
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators.progress import latest_progress
from tidemark.sources.listing import clean_listing
from tidemark.streaming import streams as S

SCHEMA = "event_id long, ts timestamp_ntz, run_id string, stage string, bytes_done long"


def _land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def _rows(n, start=0, base=datetime(2024, 1, 1)):
    stages = ["downloading", "extracting", "compressing", "completed", "failed"]
    return [(i, base + timedelta(minutes=7 * i), f"R{i % 5}", stages[i % 5], i * 10) for i in range(start, start + n)]


def _events(spark, src):
    return spark.readStream.schema(SCHEMA).parquet(str(src)).withColumn("event_ts", S.event_time("ts"))


def test_stream_latest_equals_batch(spark, tmp_path):
    src = tmp_path / "src"
    _land(spark, src, _rows(40))
    _land(spark, src, _rows(40, 40))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = S.run_stream(S.stream_latest(_events(spark, src).drop("event_ts")), out, ck, mode="update")
    q.awaitTermination()
    got = sorted(tuple(r) for r in S.read_updates(spark, out, ["run_id"]).select("run_id", "event_id").collect())
    want = sorted(tuple(r) for r in latest_progress(spark.read.parquet(str(src))).select("run_id", "event_id")
                  .collect())
    assert got == want


def test_stream_counts_complete_equals_batch(spark, tmp_path):
    src = tmp_path / "src"
    _land(spark, src, _rows(300))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    S.run_stream(S.stream_counts(_events(spark, src), "event_ts", "stage", "1 day", "1 hour"), out, ck,
                 mode="complete").awaitTermination()
    got = sorted((r["stage"], r["n"]) for r in spark.read.parquet(out).groupBy("stage").agg(F.sum("n").alias("n"))
                 .collect())
    want = sorted(tuple(r) for r in spark.read.parquet(str(src)).groupBy("stage").count().collect())
    assert got == want


def test_stream_dedupe_drops_redeliveries(spark, tmp_path):
    src = tmp_path / "src"
    rows = _rows(50)
    _land(spark, src, rows)
    _land(spark, src, rows[10:20])  # re-delivered
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    S.run_stream(S.stream_dedupe(_events(spark, src), ["event_id"], "event_ts", "1 day"), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 50


def test_late_rows_dropped_and_counted(spark, tmp_path):
    src = tmp_path / "src"
    _land(spark, src, _rows(20))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    ev = _events(spark, src)
    # stream_counts applies the late policy (watermark) itself
    agg = S.stream_counts(ev, "event_ts", "stage", "1 hour", "10 minutes")
    q = S.run_stream(agg, out, ck, mode="append")
    q.awaitTermination()
    # a row far behind the watermark arrives in a later batch
    _land(spark, src, [(999, datetime(2023, 12, 1), "R9", "failed", 1)])
    q = S.run_stream(agg, out, ck, mode="append")
    q.awaitTermination()
    total = spark.read.parquet(out).agg(F.sum("n")).first()[0] or 0
    assert total <= 20
    assert S.dropped_late(q) >= 1


def test_incremental_ingest_is_idempotent(spark, tmp_path):
    src, dst, ck = tmp_path / "land", str(tmp_path / "table"), str(tmp_path / "ck")
    schema = "bucket string, key string, size long, etag string"
    spark.createDataFrame([("b", "p/a", 1, None), ("b", "p/dir/", 0, None)], schema).write.parquet(str(src / "f1"))
    clean = lambda d: clean_listing(d, on_error="quarantine")
    S.ingest_incremental(spark, str(src) + "/*", dst, ck, schema, transform=clean)
    n1 = spark.read.parquet(dst).count()
    S.ingest_incremental(spark, str(src) + "/*", dst, ck, schema, transform=clean)
    assert spark.read.parquet(dst).count() == n1 == 1
    spark.createDataFrame([("b", "p/c", 3, None), ("b", "p/a", 7, '"e2"')], schema).write.parquet(str(src / "f2"))
    S.ingest_incremental(spark, str(src) + "/*", dst, ck, schema, transform=clean)
    assert spark.read.parquet(dst).count() == 3
    # upsert view: the re-landed object wins
    cur = {r["key"]: r["size"] for r in S.read_updates(spark, dst, ["bucket", "key"]).collect()}
    assert cur == {"p/a": 7, "p/c": 3}


def test_stream_retries_state_machine(spark, tmp_path):
    schema = "file_id string, chunk_id long, seq long, ok boolean, ts timestamp_ntz"
    t = datetime(2024, 1, 1)
    rows = [("f", 0, i, False, t + timedelta(seconds=i)) for i in range(1, 6)]
    rows += [("f", 1, 1, False, t), ("f", 1, 2, True, t + timedelta(seconds=2))]
    rows += [("f", 2, 1, False, t)]
    src = tmp_path / "att"
    spark.createDataFrame(rows, schema).write.parquet(str(src))
    late = [("z", 0, 1, True, t + timedelta(days=1))]  # advances the watermark
    spark.createDataFrame(late, schema).write.mode("append").parquet(str(src))
    att = spark.readStream.schema(schema).parquet(str(src)).withColumn("event_ts", S.event_time("ts"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    S.run_stream(S.stream_retries(att, 3, "1 hour"), out, ck).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("file_id", "chunk_id", "failures", "status")
                 .collect())
    assert ("f", 0, 4, "fatal") in got and ("f", 1, 1, "done") in got and ("f", 2, 1, "stalled") in got


def test_stream_retries_across_batches(spark, tmp_path):
    """State and deadlines carry over micro-batches: a chunk that goes on within the
    timeout keeps its failures; one that does not is stalled; the newest are open."""
    src, t = tmp_path / "src", datetime(2024, 1, 1)
    schema = "file_id string, chunk_id long, seq long, ok boolean, ts timestamp_ntz"
    batches = [
        [("f", 1, 1, False, t), ("f", 2, 1, False, t)],
        [("f", 1, 2, False, t + timedelta(minutes=1))],
        [("f", 1, 3, True, t + timedelta(minutes=2)), ("g", 7, 1, False, t + timedelta(hours=9))],
    ]
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        att = spark.readStream.schema(schema).parquet(str(src)).withColumn("event_ts", S.event_time("ts"))
        S.run_stream(S.stream_retries(att, 3, "1 hour"), out, ck).awaitTermination()
    got = sorted((r["file_id"], r["chunk_id"], r["failures"], r["status"]) for r in spark.read.parquet(out).collect())
    assert got == [("f", 1, 2, "done"), ("f", 2, 1, "stalled")]


def test_stream_retries_keeps_many_files_in_few_state_rows(spark, tmp_path):
    """Chunks of many files share a state row, and null keys and order values are attempts too."""
    src, t = tmp_path / "src", datetime(2024, 1, 1)
    schema = "file_id string, chunk_id long, seq long, who string, ok boolean, ts timestamp_ntz"
    first = [(f"f{i}", i % 3, 1, "a", False, t) for i in range(300)] + [("n", None, 1, None, False, t), (None, 4, None, "b", False, t)]
    second = [(f"f{i}", i % 3, s, w, False, t + timedelta(minutes=s)) for i in range(200) for s, w in ((2, None), (2, "b"), (3, "c"))]
    second += [("n", None, 2, "a", True, t), ("n", None, None, "a", False, t), (None, 4, 2, "a", None, t)]
    end = [("z", 0, 1, "a", False, t + timedelta(hours=9))]
    out, ck, rows = str(tmp_path / "out"), str(tmp_path / "ck"), []
    for batch in (first, second, end):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(src))
        att = spark.readStream.schema(schema).parquet(str(src)).withColumn("event_ts", S.event_time("ts"))
        q = S.run_stream(S.stream_retries(att, 3, "1 hour", order=["seq", "who"], groups=4), out, ck)
        q.awaitTermination()
        rows.append(max(p.stateOperators[0].numRowsTotal for p in q.recentProgress))
    assert max(rows) <= 4
    got = {(r["file_id"], r["chunk_id"]): (r["failures"], r["status"]) for r in spark.read.parquet(out).collect()}
    assert got.pop(("n", None)) == (1, "done") and got.pop((None, 4)) == (2, "stalled")
    assert got == {(f"f{i}", i % 3): (4, "fatal") if i < 200 else (1, "stalled") for i in range(300)}


def test_dropped_late_listener_counts_every_update(spark, tmp_path):
    src = tmp_path / "src"
    _land(spark, src, _rows(20))
    out, ck, seen = str(tmp_path / "out"), str(tmp_path / "ck"), S.DroppedLate()
    spark.streams.addListener(seen)
    try:
        agg = S.stream_counts(_events(spark, src), "event_ts", "stage", "1 hour", "10 minutes")
        S.run_stream(agg, out, ck).awaitTermination()
        _land(spark, src, [(999, datetime(2023, 12, 1), "R9", "failed", 1)])
        q = S.run_stream(agg, out, ck)
        q.awaitTermination()
        for _ in range(100):  # the listener hears of updates a little later
            if seen.rows.get(str(q.id)):
                break
            time.sleep(0.1)
        assert seen.rows[str(q.id)] >= 1
    finally:
        spark.streams.removeListener(seen)


def test_windows_and_sessions_equal_batch_after_a_flush(spark, tmp_path):
    """The streams emit what the watermark has closed; an event far ahead closes all the rest."""
    src, rows = tmp_path / "src", _rows(120)
    _land(spark, src, rows)
    _land(spark, src, [(999, rows[-1][1] + timedelta(days=30), "flush", "failed", 0)])
    for name, make, cols in (("w", lambda e: S.stream_speed(e, window="1 hour", slide="30 minutes", lateness="1 hour"),
                              ["window_start", "run_id", "samples", "bytes_per_s"]),
                             ("s", lambda e: S.stream_sessions(e, gap="30 minutes"), ["run_id", "session_start", "session_end", "events", "max_bytes"])):
        out, ck = str(tmp_path / f"out-{name}"), str(tmp_path / f"ck-{name}")
        S.run_stream(make(_events(spark, src)), out, ck).awaitTermination()
        batch = make(spark.read.parquet(str(src)).where("run_id <> 'flush'").withColumn("event_ts", S.event_time("ts")))
        got = sorted(tuple(r) for r in spark.read.parquet(out).where("run_id <> 'flush'").select(*cols).collect())
        assert got == sorted(tuple(r) for r in batch.select(*cols).collect()) and got


def test_late_rows_are_kept_and_replays_agree(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    t = datetime(2024, 1, 1)
    batches = [[(1, t, "A", "failed", 1), (2, t + timedelta(hours=5), "A", "failed", 1)],
               [(3, t + timedelta(hours=3), "A", "failed", 1), (4, t + timedelta(hours=4), "A", "failed", 1), (5, None, "A", "failed", 1)],
               [(6, t + timedelta(hours=4, minutes=1), "A", "failed", 1), (7, t + timedelta(hours=9), "A", "failed", 1)],
               [(8, t + timedelta(hours=7, minutes=59), "A", "failed", 1)]]
    for rows in batches:
        _land(spark, src, rows)
        stream = _events(spark, src)
        S.run_late_split(stream, out, ck, lateness="1 hour").awaitTermination()
    on_time, late, marks = S.read_split(spark, out, stream.schema)
    ids = lambda df: sorted(r["event_id"] for r in df.collect())
    assert ids(late) == [3, 8] and ids(on_time) == [1, 2, 4, 5, 6, 7]  # 4 lies on the watermark, 5 has no time
    assert sorted((r["n_rows"], r["late_rows"]) for r in marks.collect()) == [(1, 1), (2, 0), (2, 0), (3, 1)]
    # the last batch once more, as after a lost driver: its own folders, the same rows
    os.remove(str(tmp_path / "ck" / "commits" / "3"))
    for f in (tmp_path / "ck" / "commits").glob(".3*"):
        f.unlink()
    S.run_late_split(_events(spark, src), out, ck, lateness="1 hour").awaitTermination()
    on_time, late, _ = S.read_split(spark, out, stream.schema)
    assert ids(late) == [3, 8] and ids(on_time) == [1, 2, 4, 5, 6, 7]


def test_final_states_end_and_are_forgotten(spark, tmp_path):
    """Many runs, one after another: the state holds those of the last while only."""
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    t, held = datetime(2024, 1, 1), []
    for b in range(5):
        _land(spark, src, [(100 * b + 2 * i + k, t + timedelta(hours=6 * b, minutes=i % 50 + k), f"R{b}-{i}", "completed" if k else "downloading", k) for i in range(50) for k in (0, 1)])
        q = S.run_stream(S.stream_final(_events(spark, src), idle="1 hour", lateness="1 hour"), out, ck, state_partitions=2)
        q.awaitTermination()
        held.append(max(op.numRowsTotal for p in q.recentProgress for op in p.stateOperators))
    assert max(held) <= 100  # not the 250 runs that there were
    got = {r["run_id"]: (r["stage"], r["events"]) for r in spark.read.parquet(out).collect()}
    assert len(got) == 200 and set(got.values()) == {("completed", 2)}


def test_compaction_reads_one_snapshot_and_the_batches_after_it(spark, tmp_path):
    from tidemark.streaming import compact as C
    sink = str(tmp_path / "sink")
    put = lambda b, rows: spark.createDataFrame(rows, "k string, v long").write.mode("overwrite").parquet(f"{sink}/batch_id={b}")
    read = lambda: {r["k"]: r["v"] for r in S.read_updates(spark, sink, ["k"]).collect()}
    put(0, [("a", 1), ("b", 1)])
    put(1, [("a", 2), ("c", 2)])
    before = read()
    assert C.pointer(spark, sink) is None and C.compact(spark, sink, ["k"], 1) == 0 and C.pointer(spark, sink) == (0, 1)
    assert read() == before == {"a": 2, "b": 1, "c": 2}
    put(2, [("b", 3)])
    files = {f.split(sink)[1].split("/part")[0] for f in S.read_updates(spark, sink, ["k"]).inputFiles()}
    assert files == {".compacted/snapshots/version=0", "/batch_id=2"}
    put(1, [("a", 2), ("c", 2)])  # a replay of a batch that is in the snapshot already
    # a compaction that ended before its pointer was written leaves the former one valid, and is done again
    spark.createDataFrame([("z", 9, 9)], "k string, v long, batch_id long").write.parquet(f"{sink}.compacted/snapshots/version=1")
    os.makedirs(f"{sink}.compacted/pointers/version=1/_temporary")
    assert read() == {"a": 2, "b": 3, "c": 2} and C.compact(spark, sink, ["k"], 1) == 0
    assert C.compact(spark, sink, ["k"], 2) == 1 and C.pointer(spark, sink) == (1, 2) and read() == {"a": 2, "b": 3, "c": 2}
    put(3, [("a", 4)])
    assert read() == {"a": 4, "b": 3, "c": 2}


def test_tagged_union(spark, tmp_path):
    from tidemark.sources import tagged
    lines = ['{"type":"Log","data":{"level":"INFO","message":"a \\"q\\""}}', '{"type":"Completed"}', '{"type":"Completed","data":null}', '{"type":"Nope","data":{}}', "junk", "",
             '{"type":"Started","data":{"total":3}}', '{"type":"Started","data":{"total":"x"}}', '{"type":"Started"}', '{"type":"Started","data":[1]}', '{"type":7}', "[1]",
             '{"type":"DryRun","data":{"files":[{"run_id":"R","file1":"f","size1":1}]}}', '{"type":"Metadata","data":{"records":[{"run_accession":"R"}]}}']
    path = tmp_path / "ev"
    path.mkdir()
    (path / "a.json").write_text("\n".join(lines) + "\n")
    got = tagged.read_tagged(spark, str(path), stream=False)
    assert [(r["tag"], r["reason"]) for r in got.collect()] == [
        ("Log", None), ("Completed", None), ("Completed", None), ("Nope", "unknown type"), (None, "bad json"), (None, "bad json"), ("Started", None), ("Started", "bad data"),
        ("Started", "bad data"), ("Started", "bad data"), ("7", "unknown type"), (None, "bad json"), ("DryRun", None), ("Metadata", None)]
    assert tagged.variant(got, "Log").first().asDict() == {"level": "INFO", "message": 'a "q"'} and tagged.variant(got, "Started").collect()[0]["total"] == 3
    assert tagged.variant(got, "DryRun").first()["files"][0]["file2"] is None and tagged.variant(got, "Completed").count() == 2
    assert sorted(r["line"] for r in tagged.rejects(got).collect()) == sorted(lines[i] for i in (3, 4, 5, 7, 8, 9, 10, 11))
    upload = tagged.parse_tagged(spark.createDataFrame([('{"type":"DryRun","data":{"files":["a","b"]}}',)], "value string"), tagged.UPLOAD_EVENTS)
    assert upload.first()["dry_run"]["files"] == ["a", "b"]
