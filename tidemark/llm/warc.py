"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with whole WARC
records, followed by a seek table in a skippable frame (the Zstandard seekable
format: any Zstandard tool reads the bundle through, a seeking reader finds a
frame from the table).  An index maps each record to its bundle, frame, and
offset inside the frame's content, so one record costs one frame.

Records of equal payloads are told by their SHA-1 before writing: that with
the smallest page id is a response, the others are revisits that refer to it.

Writing goes through Spark's own file writer, so task retries and lost
executors leave no half bundle, and any file system that Spark knows will do.
A bundle is one row of a text table whose line ending is the seek table's
magic number, the bundle's last four bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lookup, pick, stored

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 16 << 20, 3
# The seekable format's numbers. Fixed values.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None, url: str | None = None, digest: str = "") -> str:
    """A record's name; without a page id it is made from what the record holds."""
    if page_id is not None:
        return f"urn:page:{page_id}"
    return f"urn:page:none:{hashlib.sha1((url or '').encode('utf-8', 'surrogatepass')).hexdigest()}:{digest}"


def page_of(uri: str | None) -> int | None:
    """The page id in a record's name, if it has one."""
    number = (uri or "").strip("<>").removeprefix("urn:page:")
    return int(number) if number.lstrip("-").isdigit() else None


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    name = record_uri(page_id, url, digest)
    target = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m.group()[0], (url or name).encode("utf-8", "surrogatepass"))
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
            f"WARC-Record-ID: <{name}>".encode(), b"WARC-Target-URI: " + target, f"WARC-Date: {date}".encode(),
            f"WARC-Payload-Digest: sha1:{digest}".encode(), f"X-Payload-Length: {len(payload)}".encode()]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block = http + payload
    else:
        block = http
        head += [f"WARC-Refers-To: <{record_uri(refers_to)}>".encode(),
                 b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record in a frame's content."""
    at = 0
    while at < len(data):
        split = data.index(b"\r\n\r\n", at)
        lines = data[at:split].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at offset {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        end = split + 4 + int(head["Content-Length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"WARC record at offset {at} does not end where it says")
        yield at, end + 4 - at, head, data[split + 4:end]
        at = end + 4


def payload(block: bytes) -> bytes:
    """The body of an HTTP message."""
    return block[block.index(b"\r\n\r\n") + 4:]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame with each frame's compressed and content size."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, content size) of each frame, from a bundle's last bytes."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    entry = 12 if flags & 0x80 else 8
    table, out, at = bundle[-9 - n * entry:-9], [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", table, i * entry)
        out.append((at, c, d))
        at += c
    return out


def read_frame(bundle: bytes, frame: int) -> bytes:
    at, size, content = read_seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at:at + size], max_output_size=max(content, 1))


def _bundles(frame_bytes: int, bundle_bytes: int, date: str):
    """Records to whole bundles (without their last four bytes), one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        frames, sizes, held, held_bytes, n = [], [], [], 0, 0

        def close_frame() -> None:
            nonlocal held, held_bytes
            if held:
                data = b"".join(held)
                frames.append(tool.compress(data))
                sizes.append((len(frames[-1]), len(data)))
                held, held_bytes = [], 0

        def close_bundle() -> pa.RecordBatch:
            nonlocal frames, sizes
            body = b"".join([*frames, seek_table(sizes)])[:-4]
            frames, sizes = [], []
            return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], names=["body"])

        for b in batches:
            for i in range(b.num_rows):
                page_id, url, html, sha, first = (c[i].as_py() for c in b.columns)
                held.append(_record(page_id, url, html, base64.b32encode(sha).decode(), first, date))
                held_bytes += len(held[-1])
                if held_bytes >= frame_bytes:
                    close_frame()
                    if sum(s for s, _ in sizes) >= bundle_bytes:
                        yield close_bundle()
        close_frame()
        if frames:
            yield close_bundle()
    return run


def decide(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, html, sha, first): payload bytes, their SHA-1, and for
    revisits the id of the response.  Digests of at least two pages are looked up;
    they are aggregated before anything is shuffled, and the pages stay where they are."""
    rows = pick(pages, id_col, url_col, html_col).select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html")))
    groups = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.bool_or(F.isnull("id")).alias("unnamed"))
    groups = stored(groups.where("first <> last or (first is not null and unnamed)").select("sha", "first"), "warc-groups")
    later = (F.col("first") < F.col("id")) | F.isnull("id")
    first = F.when((F.octet_length("html") >= min_bytes) & later, F.col("first"))
    return lookup(rows, groups, ["sha"]).select("id", "url", "html", "sha", first.alias("first"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
                  date: str = DATE, **columns) -> None:
    """Write a record for every page into bundles under ``path``.

    A null url is written as the record's own name, control characters and spaces
    in urls percent-encoded.  Null pages have an empty payload; a payload longer than
    a frame or a bundle has one for itself.  Rows without an id get a name made from
    url and payload; they revisit a page of the same payload that has an id, and are responses
    if there is none.  Of rows that repeat both id and payload none refers to another.
    """
    bounded_batches(pages.sparkSession)
    bundles = decide(pages, min_bytes, **columns).mapInArrow(_bundles(frame_bytes, bundle_bytes, date), "body binary")
    (bundles.select(F.col("body").cast("string").alias("value")).write.option("lineSep", struct.pack("<I", SEEKABLE).decode("latin-1"))
     .option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path))


_INDEX = ("record_id string, bundle string, frame int, frame_start long, frame_bytes long, record_start long, record_bytes long, "
          "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string")


def index_archive(spark: SparkSession, path: str) -> DataFrame:
    """The index, from the bundles themselves: every frame is read, every record
    parsed, and every response's payload held against its digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, bundle = (c[i].as_py() for c in b.columns)
                for f, (at, size, _) in enumerate(read_seek_table(bundle)):
                    rows = []
                    for start, length, head, block in parse(read_frame(bundle, f)):
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response" and base32_sha1(payload(block)) != digest:
                            raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
                        rows.append((head["WARC-Record-ID"].strip("<>"), name, f, at, size, start, length, page_of(head["WARC-Record-ID"]),
                                     head["WARC-Type"], int(head["X-Payload-Length"]), digest, page_of(head.get("WARC-Refers-To")), head["WARC-Target-URI"]))
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    names = [x.split()[0] for x in _INDEX.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _INDEX.split(", ")])
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(run, _INDEX)


def read_records(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """(record_id, payload) for rows of an archive's index: each bundle is opened once, and
    only the frames that hold wanted records are decompressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                out = []
                for f in sorted({w["frame"] for w in r["wanted"]}):
                    data = read_frame(r["content"], f)
                    for w in r["wanted"]:
                        if w["frame"] == f:
                            _, _, _, block = next(parse(data[w["record_start"]:w["record_start"] + w["record_bytes"]]))
                            out.append((w["record_id"], payload(block)))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.binary()))], names=["record_id", "payload"])

    wanted = index.groupBy("bundle").agg(F.collect_list(F.struct("record_id", "frame", "record_start", "record_bytes")).alias("wanted"))
    files = spark.read.format("binaryFile").load(path).withColumnRenamed("path", "bundle")
    return files.join(wanted, "bundle").select("content", "wanted").mapInArrow(run, "record_id string, payload binary")
