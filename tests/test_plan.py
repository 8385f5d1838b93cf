"""Planning tables: chunks, resume decisions, retries, backoff, locators."""

import json

from pyspark.sql import functions as F

from tidemark.operators.checksum import check_integrity
from tidemark.plans import resume as R
from tidemark.sources.locators import extract_locators
from tidemark.sources.state import parse_chunk_state, read_chunk_state

MiB = 1 << 20


def test_chunk_plan_ranges(spark):
    files = spark.createDataFrame([("a", 10), ("b", 0), ("c", 25), ("d", None)], "file_id string, size long")
    got = sorted(tuple(r) for r in R.chunk_plan(files, 10).collect())
    assert got == [("a", 0, 0, 9), ("c", 0, 0, 9), ("c", 1, 10, 19), ("c", 2, 20, 24)]


def test_chunk_plan_splits_huge_files(spark):
    n = R.CHUNKS_PER_BLOCK * 3 + 5
    files = spark.createDataFrame([("big", n * 7 - 3)], "file_id string, size long")
    plan = R.chunk_plan(files, 7)
    s = plan.agg(F.count("*").alias("n"), F.max("chunk_id").alias("mx"), F.max("end").alias("e")).first()
    assert (s["n"], s["mx"], s["e"]) == (n, n - 1, n * 7 - 4)


def test_state_and_resume_decision_reference_case(spark, tmp_path):
    # state file keeps chunks [0, 2]; local file has the full size -> RESUME
    p = tmp_path / "SRR1.sra.meta.json"
    p.write_text(json.dumps({"downloaded_chunks": [0, 2]}))
    (tmp_path / "SRR9.sra.meta.json").write_text("{not json")
    st = read_chunk_state(spark, str(tmp_path / "*.meta.json"))
    assert sorted(tuple(r) for r in st.collect()) == [("SRR1.sra", 0), ("SRR1.sra", 2)]
    remote = spark.createDataFrame([("SRR1.sra", 10 * MiB), ("SRR2.sra", 5), ("SRR3.sra", 7), ("SRR4.sra", 9)],
                                   "file_id string, size long")
    local = spark.createDataFrame([("SRR1.sra", 10 * MiB), ("SRR2.sra", 5), ("SRR3.sra", 8)],
                                  "file_id string, local_size long")
    state = st.unionByName(spark.createDataFrame([("SRR4.sra", 0)], "file_id string, chunk_id long"))
    d = {r["file_id"]: (r["decision"], r["stale_state"]) for r in R.resume_decision(remote, local, state).collect()}
    assert d == {"SRR1.sra": ("RESUME", False), "SRR2.sra": ("VERIFY", False), "SRR3.sra": ("RESTART", False),
                 "SRR4.sra": ("NEW", True)}
    held = {r["file_id"]: r["bytes_held"] for r in R.resume_bytes(remote, state, 4 * MiB).collect()}
    # chunk 0 = 4 MiB, chunk 2 = [8 MiB, 10 MiB) = 2 MiB
    assert held["SRR1.sra"] == 6 * MiB and held["SRR4.sra"] == 9 and held["SRR2.sra"] == 0


def test_chunk_state_lenient(spark):
    df = spark.createDataFrame([("a", '{"downloaded_chunks":[1,1,3]}'), ("b", "garbage"), ("c", '{"x":1}'),
                                ("d", '{"downloaded_chunks":[2,-1]}'), ("e", '{"downloaded_chunks":[1.5]}')],
                               "file_id string, state_json string")
    assert sorted(tuple(r) for r in parse_chunk_state(df).collect()) == [("a", 1), ("a", 3)]


def test_integrity_reference_case(spark):
    # bytes 'bad' against the md5 of an empty file, size 3 -> invalid; unknown md5 -> size only
    remote = spark.createDataFrame([("f", 3, "d41d8cd98f00b204e9800998ecf8427e"), ("g", 3, None),
                                    ("h", 3, "D41D8CD98F00B204E9800998ECF8427E")], "file_id string, size long, md5 string")
    local = spark.createDataFrame([("f", 3, "4d5f6b1b1a2bd7d1d0c7e8b0f9a2c0e1"), ("g", 3, "x"),
                                   ("h", 0, "d41d8cd98f00b204e9800998ecf8427e")],
                                  "file_id string, local_size long, local_md5 string")
    got = {r["file_id"]: (r["method"], r["valid"]) for r in check_integrity(remote, local).collect()}
    assert got == {"f": ("md5", False), "g": ("size", True), "h": ("md5", False)}


def test_ftp_decision(spark):
    tasks = spark.createDataFrame([("a", 10, "m"), ("b", 10, "m"), ("c", 10, "m"), ("d", 10, "m"), ("e", 0, "m")],
                                  "filename string, total_size long, md5 string")
    local = spark.createDataFrame([("a", 10, "m"), ("b", 10, "x"), ("c", 4, None), ("e", 0, "m")],
                                  "filename string, local_size long, local_md5 string")
    got = {r["filename"]: r["decision"] for r in R.ftp_decision(tasks, local).collect()}
    assert got == {"a": "SKIP", "b": "MISMATCH", "c": "RESUME", "d": "NEW", "e": "NEW"}


def test_chunk_retries_budget(spark):
    rows = [("f", 0, i, False) for i in range(1, 6)] + [("f", 1, 1, False), ("f", 1, 2, True)]
    a = spark.createDataFrame(rows, "file_id string, chunk_id long, seq long, ok boolean")
    acts = [(r["chunk_id"], r["seq"], r["action"]) for r in R.chunk_retries(a).orderBy("chunk_id", "seq").collect()]
    assert acts[:5] == [(0, 1, "requeue"), (0, 2, "requeue"), (0, 3, "requeue"), (0, 4, "fatal"), (0, 5, "fatal")]
    assert acts[5:] == [(1, 1, "requeue"), (1, 2, "done")]
    summ = {r["chunk_id"]: (r["failures"], r["requeues"], r["fatal"]) for r in R.chunk_retry_summary(a).collect()}
    assert summ == {0: (5, 3, True), 1: (1, 1, False)}


def test_backoff_cost(spark):
    rows = [("f", 0, i, "stream", False) for i in range(1, 26)]
    rows += [("g", 0, i, "range", False) for i in range(1, 12)]
    rows += [("h", 0, 1, "stream", False), ("h", 0, 2, "stream", True), ("h", 0, 3, "range", False)]
    a = spark.createDataFrame(rows, "file_id string, chunk_id long, seq long, kind string, progressed boolean")
    got = {r["file_id"]: (r["sleep_s"], r["gave_up"]) for r in R.backoff_cost(a).collect()}
    assert got["f"] == (2 + 4 + 8 + 16 + 30 * 16, True)     # 20 sleeps, the 21st try gives up
    assert got["g"] == (sum(range(1, 11)), True)             # range path: k seconds, gives up after 10
    assert got["h"] == (2 + 2 + 2, False)                    # progress resets the counter


def test_locators_document_order_and_case(spark):
    xml = """<RUN_SET><Run md5="aaa" size="5"><SRAFiles>
      <SRAFile MD5="m1" Size="100"><Alternatives org="NCBI" free_egress="worldwide" url="https://x.s3.amazonaws.com/a"/>
        <alternatives ORG="aws" FREE_EGRESS="-" url="https://x.s3.amazonaws.com/paid"/></SRAFile>
      <SRAFile size="n/a"><Alternatives org="AWS" free_egress="Worldwide" url="ftp://not-resolvable"/>
        <Alternatives org='AWS' free_egress='worldwide' url='s3://odp/sra/R1/R1.1'/></SRAFile>
    </SRAFiles></Run></RUN_SET>"""
    none = '<RUN><SRAFile md5="z" size="1"><Alternatives org="AWS" free_egress="-" url="s3://b/k"/></SRAFile></RUN>'
    df = spark.createDataFrame([("R1", xml), ("R2", none)], "run_id string, xml string")
    got = {r["run_id"]: r for r in extract_locators(df).collect()}
    r1 = got["R1"]
    # the second SRAFile reset md5 (absent -> null) and size (bad -> 0)
    assert (r1["s3_uri"], r1["http_url"], r1["md5"], int(r1["size"])) == (
        "s3://odp/sra/R1/R1.1", "https://odp.s3.amazonaws.com/sra/R1/R1.1", None, 0)
    assert got["R2"]["s3_uri"] is None


def test_has_fastq(spark):
    runs = spark.createDataFrame([("X",), ("Y",), ("Z",), ("W",)], "run_id string")
    inv = spark.createDataFrame([("X_1.fastq", 5), ("Y.fastq", 3), ("Z_2.fastq", 9), ("W_1.fastq", 0)],
                                "filename string, length long")
    got = {r["run_id"]: r["has_fastq"] for r in R.has_fastq(runs, inv).collect()}
    assert got == {"X": True, "Y": True, "Z": False, "W": False}


def test_listing_cleanup_and_error_modes(spark):
    import pytest
    from tidemark.sources.listing import clean_listing, lookup_object
    rows = [("b", "p/a.nsq", 5, '"d41d8cd98f00b204e9800998ecf8427e"'), ("b", None, 1, None), ("b", "p/x", None, None),
            ("b", "p/dir/", 0, None), ("b", "p/dir2/", 3, None), ("b", "p/neg", -1, None)]
    df = spark.createDataFrame(rows, "bucket string, key string, size long, etag string")
    q = {r["key"]: r["reason"] for r in clean_listing(df, "p/", on_error="quarantine").collect()}
    assert set(q) == {"p/a.nsq", "p/dir2/", "p/neg"} and q["p/neg"].startswith("S3 object has an invalid size")
    # an excluded key is never checked
    assert clean_listing(df, "p/", exclude="ne*").count() == 2
    with pytest.raises(Exception):
        clean_listing(df, "p/").collect()
    assert lookup_object(df, "b", "p/a.nsq").first()["md5"] == "d41d8cd98f00b204e9800998ecf8427e"
    with pytest.raises(ValueError):
        lookup_object(df, "b", "p/dir/")
    with pytest.raises(Exception):
        lookup_object(df, "b", "p/x").collect()
