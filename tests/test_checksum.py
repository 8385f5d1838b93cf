"""Checksum family: directory inventory, manifests, verification."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators.checksum import (file_md5, manifest_rows, reconcile, verify_manifest, verify_manifest_at,
                                         verify_summary)
from tidemark.sources.manifest import parse_manifest_lines, read_inventory, read_manifest
from tidemark.sources.text import read_numbered_lines
from tidemark.sinks.writers import write_manifest


def _tree(tmp_path):
    d = tmp_path / "data"
    d.mkdir()
    (d / "data.fa").write_text("acgt")
    (d / "transfer_md5_2026-07-17_13-32-27.log").write_text("log")
    (d / ".hidden").write_text("secret")
    sub = d / "sub"
    sub.mkdir()
    (sub / "b.txt").write_text("hello\n")
    hid = d / ".cache"
    hid.mkdir()
    (hid / "c.txt").write_text("x")
    return d


def test_inventory_skips_hidden_and_logs(spark, tmp_path):
    d = _tree(tmp_path)
    inv = read_inventory(spark, str(d))
    names = sorted(os.path.basename(r["path"]) for r in inv.collect())
    assert names == ["b.txt", "data.fa"]


def test_file_md5_small_and_large_paths_agree(spark, tmp_path):
    d = _tree(tmp_path)
    (d / "big.bin").write_bytes(os.urandom(3 << 20))
    want = {p.name: hashlib.md5(p.read_bytes()).hexdigest() for p in [d / "data.fa", d / "sub" / "b.txt", d / "big.bin"]}
    for limit in (64 << 20, 1):  # everything inline / everything via the path reader
        got = {os.path.basename(r["path"]): r["actual_md5"] for r in file_md5(spark, str(d), limit).collect()}
        assert got == want


def test_verify_reference_case(spark, tmp_path):
    # manifest: md5 of "acgt" for data.fa, zero md5s for the tool's log and md5.txt -> (1, 0)
    acgt = hashlib.md5(b"acgt").hexdigest()
    m = tmp_path / "m"
    m.mkdir()
    (m / "md5.txt").write_text(f"{acgt}  data.fa\n{'0' * 32}  transfer_md5_run.log\n{'0' * 32}  md5.txt\n")
    entries = read_manifest(spark, str(m / "md5.txt"))
    d = _tree(tmp_path)
    actual = file_md5(spark, str(d)).select(F.substring_index("path", "/", -1).alias("filename"), "actual_md5")
    v = verify_manifest(entries, actual, manifest_name="md5.txt")
    s = verify_summary(v).first()
    assert (s["passed"], s["failed"]) == (1, 0)


def test_verify_missing_mismatch_and_duplicates(spark):
    e = spark.createDataFrame([("a", "AA" * 16), ("a", "aa" * 16), ("b", "bb" * 16), ("c", "cc" * 16),
                               ("d", "dd" * 16)], "filename string, md5 string")
    a = spark.createDataFrame([("a", "aa" * 16), ("b", "00" * 16), ("d", "dd" * 16), ("d", "ee" * 16),
                               ("z", "zz" * 16)], "filename string, actual_md5 string")
    got = sorted((r["filename"], r["status"]) for r in verify_manifest(e, a).collect())
    assert got == [("a", "OK"), ("a", "OK"), ("b", "MISMATCH"), ("c", "MISSING"), ("d", "AMBIGUOUS")]
    s = verify_summary(verify_manifest(e, a)).first()
    assert (s["passed"], s["failed"]) == (2, 3)
    empty = verify_summary(verify_manifest(e.limit(0), a)).first()
    assert (empty["passed"], empty["failed"]) == (0, 0)


def test_manifest_parse_errors_carry_line_numbers(spark, tmp_path):
    p = tmp_path / "m.txt"
    good = hashlib.md5(b"x").hexdigest()
    p.write_text(f"# header\n\n  {good.upper()}  dir/a b.txt  \n{good} single.txt\nzz{good[2:]}  bad.txt\n")
    q = read_manifest(spark, str(p), mode="quarantine").orderBy("line_no").collect()
    assert [(r["line_no"], r["md5"], r["filename"]) for r in q][0] == (3, good, "dir/a b.txt")
    assert "Invalid line 4" in q[1]["error"]
    assert "Invalid MD5 on line 5" in q[2]["error"]
    with pytest.raises(Exception):
        read_manifest(spark, str(p), mode="fail").collect()


def test_numbered_lines_across_blocks(spark, tmp_path):
    p = tmp_path / "big.txt"
    p.write_text("".join(f"line {i}\n" for i in range(1, 60001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = read_numbered_lines(spark, str(p))
        assert df.rdd.getNumPartitions() > 1
        bad = df.where(F.col("value") != F.concat(F.lit("line "), F.col("line_no").cast("string"))).count()
        assert bad == 0 and df.count() == 60000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_generated_manifest_excludes_itself(spark, tmp_path):
    d = tmp_path / "g"
    d.mkdir()
    (d / "data.fa").write_text("acgt")
    (d / "md5.txt").write_text("stale")
    files = file_md5(spark, str(d))
    rows = manifest_rows(files, manifest_path=str(d / "md5.txt")).collect()
    assert [r["line"] for r in rows] == [f"{hashlib.md5(b'acgt').hexdigest()}  data.fa"]
    out = str(tmp_path / "manifest_out")
    write_manifest(files.withColumnRenamed("actual_md5", "md5"), out)
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.startswith("part"))
    assert "data.fa" in text and text.count("\n") == 2
    # round trip K3 -> S5
    back = parse_manifest_lines(spark.read.text(out).withColumn("line_no", F.lit(1)).withColumn("file", F.lit("m")))
    assert back.where(F.col("filename") == "data.fa").count() == 1


def test_manifest_crlf_and_tabs_are_trimmed(spark, tmp_path):
    good = hashlib.md5(b"y").hexdigest()
    p = tmp_path / "crlf.txt"
    p.write_bytes(f"\t{good}  a.txt\r\n{good}  b.txt \t\r\n".encode())
    got = sorted((r["md5"], r["filename"]) for r in read_manifest(spark, str(p)).collect())
    assert got == [(good, "a.txt"), (good, "b.txt")]


def test_file_uri_roots(spark, tmp_path):
    d = _tree(tmp_path)
    for root in (str(d), "file://" + str(d), "file:" + str(d)):
        assert sorted(os.path.basename(r["path"]) for r in file_md5(spark, root).collect()) == ["b.txt", "data.fa"]
        assert read_inventory(spark, root).count() == 2


def test_reconcile_shows_conflicts(spark):
    local = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("c", "4"), ("d", None)], "filename string, md5 string")
    archive = spark.createDataFrame([("a", "1"), ("b", "3"), ("b", "3"), ("e", "9")], "filename string, md5 string")
    got = {r["filename"]: r["status"] for r in reconcile(local, archive).collect()}
    assert got == {"a": "conflict", "b": "matched", "c": "local_only", "d": "local_only", "e": "archive_only"}


def test_verify_by_path_below_root(spark):
    files = spark.createDataFrame([("/r/x/a.txt", "1"), ("/r/y/a.txt", "2"), ("/r/m.md5", "3"), ("/abs/z", "4")],
                                  "path string, actual_md5 string")
    entries = spark.createDataFrame([("x/a.txt", "1"), ("./y//a.txt", "9"), ("a.txt", "1"), ("sub/transfer_md5_1.log", "0"),
                                     ("m.md5", "3"), ("/abs/z", "4")], "filename string, md5 string")
    got = {r["filename"]: r["status"] for r in verify_manifest_at(entries, files, "/r", "/r/m.md5").collect()}
    assert got == {"x/a.txt": "OK", "./y//a.txt": "MISMATCH", "a.txt": "MISSING", "/abs/z": "OK"}


def test_unknown_md5_fails_instead_of_writing_null(spark):
    files = spark.createDataFrame([("/r/a", None)], "path string, actual_md5 string")
    with pytest.raises(Exception, match="no md5 for a"):
        manifest_rows(files).collect()


def test_unreadable_file_fails_on_both_paths(tmp_path):
    import pandas as pd
    from tidemark.operators.checksum import _md5_paths
    with pytest.raises(OSError):
        list(_md5_paths([pd.DataFrame({"path": [str(tmp_path / "gone")], "length": [1]})]))


def test_canonical_paths(spark):
    import posixpath

    from tidemark.functions.columns import canonical_path
    from tidemark.operators.checksum import verify_manifest_at
    from tidemark.operators.filters import drop_artifacts
    paths = ["a/../b", "/a/./b//c", "/..", "/../a", "../x", "../../x/../y", "a/..", ".", "/", "plain", "/a/b/", "a/b/../../../c", "..a/.b/c..", "/a/.../b", "a//..//b/.", "x/"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r[0]: r[1] for r in df.select("p", canonical_path("p")).collect()}
    assert got == {p: posixpath.normpath(p) for p in paths}
    entries = spark.createDataFrame([("a/../b.txt", "M"), ("./c/./d", "n"), ("/data/x/../e", "o"), ("md5.txt", "z")], "filename string, md5 string")
    files = spark.createDataFrame([("/data/b.txt", "m"), ("/data/c/y/../d", "n"), ("/data/e", "o"), ("/data/md5.txt", "z")], "path string, actual_md5 string")
    found = verify_manifest_at(entries, files, "/data/q/..", manifest_path="/data/./md5.txt").collect()
    assert sorted((r["path"], r["status"]) for r in found) == [("/data/b.txt", "OK"), ("/data/c/d", "OK"), ("/data/e", "OK")]
    kept = drop_artifacts(files.withColumnRenamed("path", "filename").selectExpr("filename", "filename AS p"), path="p", manifest_path="/data/a/../md5.txt")
    assert kept.count() == 3
