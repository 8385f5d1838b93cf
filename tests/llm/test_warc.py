"""WARC bundles: exact round trip, seek tables and the contract's columns."""

import base64
import glob
import hashlib

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import queries, warc

from .conftest import SMALL


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows):
    first = {}
    for p, h in rows:
        first[h or ""] = min(p, first.get(h or "", p))
    return sorted((p, len((h or "").encode()), digest(h), "response" if first[h or ""] == p else "revisit",
                   None if first[h or ""] == p else first[h or ""]) for p, h in rows)


def found(df):
    return sorted(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


ROWS = [(5, "u://a", "<p>x</p>"), (3, None, "<p>x</p>"), (9, "u://c d\r\nX: y", "<p>x</p>"), (1, "", None), (2, "u://é", ""), (7, "u", "é✓\r\n\r\n"),
        (8, "u", "big " * 100_000), (4, "u", "\x00\x1a"), (11, "u", "WARC/1.1\r\n\r\n")]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "out")
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumns({"sha": F.lit(1), "ID": F.lit(2), "first": F.lit("f")})
    warc.write_archive(pages.repartition(3), path, frame_bytes=1000, bundle_bytes=3000)
    return path


def test_query_matches_brute_force_and_sql(spark, con):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    got = found(queries.QUERIES["op7_warc_bundles"](spark, SMALL))
    assert got == expected(rows) == sorted(con.execute(queries.ORACLE["op7_warc_bundles"]).fetchall())


def test_round_trip_and_revisits(spark, archive):
    index = warc.index_archive(spark, archive)
    assert found(index) == expected([(p, h) for p, _, h in ROWS])
    assert {r["page_id"]: r["url"] for r in index.collect()}[9] == "u://c%20d%0D%0AX:%20y"
    back = {r["record_id"]: bytes(r["payload"]).decode() for r in warc.read_records(spark, archive, index.where("record_type = 'response'")).collect()}
    html = {f"urn:page:{p}": h or "" for p, _, h in ROWS}
    assert back == {k: v for k, v in html.items() if k not in ("urn:page:5", "urn:page:9", "urn:page:2")}


def test_bundles_are_seekable_zstandard(spark, archive):
    files = [open(f, "rb").read() for f in glob.glob(f"{archive}/part-*")]
    records = 0
    for data in files:
        table = warc.read_seek_table(data)
        assert sum(size for _, size, _ in table) + 8 + 8 * len(table) + 9 == len(data)
        # A reader that knows nothing of the table reads the bundle through.
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert len(whole) == sum(n for _, _, n in table)
        assert whole == b"".join(warc.read_frame(data, i) for i in range(len(table)))
        for i in range(len(table)):
            frame = warc.read_frame(data, i)
            for start, length, head, block in warc.parse(frame):
                records += 1
                assert frame[start:start + length].startswith(b"WARC/1.1\r\n") and len(block) == int(head["Content-Length"])
    assert records == len(ROWS) and len(files) > 1


def test_odd_tables(spark, tmp_path):
    schema = "page_id long, url string, html string"
    empty = spark.createDataFrame([], schema)
    warc.write_archive(empty, str(tmp_path / "none"))
    assert warc.index_archive(spark, str(tmp_path / "none")).collect() == []
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "u", "a"), (3, "u", "bb")]
    warc.write_archive(spark.createDataFrame(rows, schema), str(tmp_path / "odd"), min_bytes=2)
    assert found(warc.index_archive(spark, str(tmp_path / "odd"))) == sorted((p, len(h), digest(h), "response", None) for p, _, h in rows)
    warc.write_archive(spark.createDataFrame(rows, schema), str(tmp_path / "dup"))
    assert [r[3:] for r in found(warc.index_archive(spark, str(tmp_path / "dup")))] == [("response", None), ("response", None), ("revisit", 1), ("response", None)]


def test_pages_without_an_id(spark, tmp_path, monkeypatch, con):
    rows = [(4, "u", "a"), (2, "u", "a"), (None, "u", "a"), (None, "v", "a"), (None, None, None), (None, "w", "bb"), (None, "w", "bb"), (-3, "x", "c"), (None, "x", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(queries, "read", lambda *_: pages)
    got = queries.QUERIES["op7_warc_bundles"](spark, "")
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in got.collect()), key=key)
    want = sorted(((p, len((h or "").encode()), digest(h), *kind) for (p, _, h), kind in zip(rows, [
        ("revisit", 2), ("response", None), ("revisit", 2), ("revisit", 2), ("response", None), ("response", None), ("response", None),
        ("response", None), ("revisit", -3)])), key=key)
    assert got == want
    frame = pages.toPandas().astype({"page_id": "Int64"})  # noqa: F841
    sql = queries.ORACLE["op7_warc_bundles"].replace("FROM pages", "FROM frame")
    assert sorted((tuple(r) for r in duckdb.sql(sql).fetchall()), key=key) == want
    warc.write_archive(pages, str(tmp_path / "out"))
    index = warc.index_archive(spark, str(tmp_path / "out"))
    names = [r["record_id"] for r in index.collect()]
    assert sum(n.startswith("urn:page:none:") for n in names) == 6
    back = {r["record_id"]: bytes(r["payload"]) for r in warc.read_records(spark, str(tmp_path / "out"), index.where("page_id is null and record_type = 'response'")).collect()}
    assert sorted(back.values()) == [b"", b"bb"]
