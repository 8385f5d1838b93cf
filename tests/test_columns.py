"""Column functions: the archive tool's own unit-test values plus edge cases."""

from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.functions.columns import (basename, etag_md5, file_stem, file_type, human_bytes, packed_list,
                                        relative_key, resolve_url_pair, s3_parse, s3_to_https, size_list,
                                        stage_percent, target_name, upload_key, wildcard_keep)


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_human_bytes_reference_values(spark):
    df = spark.createDataFrame([(0,), (512,), (1048576,), (1610612736,), (1023,), (2304,), (1048575,),
                                (1024 ** 5 * 3,), (1024 ** 5 * 2048,)], "b long")
    got = [r[0] for r in df.select(human_bytes("b")).collect()]
    # 2304 B = 2.25 KiB rounds half-even to 2.2; 1048575 B shows 1024.0 KiB
    assert got == ["0 B", "512 B", "1.0 MiB", "1.5 GiB", "1023 B", "2.2 KiB", "1024.0 KiB", "3.0 PiB",
                   "2048.0 PiB"]


def test_etag_md5(spark):
    vals = ['"d41d8cd98f00b204e9800998ecf8427e"', '"d41d8cd98f00b204e9800998ecf8427e-2"', None,
            '"D41D8CD98F00B204E9800998ECF8427E"']
    df = spark.createDataFrame([(v,) for v in vals], "e string")
    got = [r[0] for r in df.select(etag_md5("e")).collect()]
    assert got == ["d41d8cd98f00b204e9800998ecf8427e", None, None, "d41d8cd98f00b204e9800998ecf8427e"]


def test_s3_parse(spark):
    df = spark.createDataFrame([("s3://ncbi-blast-databases/2026-07-10/",), ("https://example.org/file",),
                                ("  s3://bucket  ",), ("s3:///key",), ("s3://b?x/k",)], "u string")
    got = [tuple(r[0]) for r in df.select(s3_parse("u")).collect()]
    assert got[0] == ("ncbi-blast-databases", "2026-07-10/", None)
    assert got[1][0] is None and got[1][2] == "not an s3 url"
    assert got[2] == ("bucket", "", None)
    assert got[3][2] == "missing bucket"
    assert got[4][2] == "invalid bucket"


def test_wildcards_include_overrides_exclude(spark):
    rows = [("nt.000.nsq", "*", "nt.*", True), ("taxdb.btd", "*", "nt.*", False), ("taxdb.btd", None, None, True),
            ("tax_db.001.x", "*", "tax_db.00?.*", True), ("taxXdb.001.x", "*", "tax_db.00?.*", False),
            ("a/b/c.txt", "*", None, False), ("a/b/c.txt", None, "x*", True), ("100%.txt", "*", "100%.txt", True),
            ("100x.txt", "*", "100%.txt", False)]
    df = spark.createDataFrame(rows, "k string, ex string, inc string, want boolean")
    got = df.select(wildcard_keep("k", F.col("ex"), F.col("inc")).alias("g"), "want").collect()
    assert [r["g"] for r in got] == [r["want"] for r in got]
    # literal patterns give the same answers
    for k, ex, inc, want in rows:
        assert one(spark, wildcard_keep(F.col("v"), ex, inc), k) == want


def test_s3_to_https(spark):
    df = spark.createDataFrame([("example-bucket", "folder/file name.gz"), ("b", "a+b=c@d/%41 #?{x}`<>\"q")],
                               "b string, k string")
    got = [r[0] for r in df.select(s3_to_https("b", "k")).collect()]
    assert got[0] == "https://example-bucket.s3.amazonaws.com/folder/file%20name.gz"
    assert got[1] == "https://b.s3.amazonaws.com/a+b=c@d/%41%20%23%3F%7Bx%7D%60%3C%3E%22q"


def test_target_name(spark):
    df = spark.createDataFrame([("s3://genome-idx/kraken/k2_viral_20240112.tar.gz", "R1"), ("s3://b/dir/", "R2")],
                               "u string, r string")
    assert [x[0] for x in df.select(target_name("u", "r")).collect()] == ["k2_viral_20240112.tar.gz", "R2"]


def test_size_list_shift_and_bounds(spark):
    v = "n/a;5;+7; 8;18446744073709551615;18446744073709551616;"
    assert one(spark, size_list(F.col("v")), v) == [Decimal(5), Decimal(7), Decimal(18446744073709551615)]
    assert one(spark, size_list(F.col("v"), aligned=True), v) == [None, Decimal(5), Decimal(7), None,
                                                                 Decimal(18446744073709551615), None, None]


def test_packed_list_and_basename(spark):
    assert one(spark, packed_list(F.col("v")), "a;;b;") == ["a", "b"]
    assert one(spark, packed_list(F.col("v")), None) == []
    assert one(spark, basename(F.col("v")), "x/y/z.gz") == "z.gz"
    assert one(spark, basename(F.col("v")), "plain") == "plain"


def test_file_stem(spark):
    df = spark.createDataFrame([("p/nt.000.nsq",), (".hidden",), ("a.",), ("noext",), ("d/x.tar.gz",)], "k string")
    assert [r[0] for r in df.select(file_stem("k")).collect()] == ["nt.000", ".hidden", "a", "noext", "x.tar"]


def test_resolve_url_pair(spark):
    df = spark.createDataFrame([("https://odp.s3.amazonaws.com/sra/1",), ("s3://b/k/x",), ("s3://nokey",),
                                ("ftp://x/y",), ("https://a/b.s3.amazonaws.com/k",)], "u string")
    got = [r[0] for r in df.select(resolve_url_pair("u")).collect()]
    assert tuple(got[4]) == ("s3://a/b/k", "https://a/b.s3.amazonaws.com/k")
    assert tuple(got[0]) == ("s3://odp/sra/1", "https://odp.s3.amazonaws.com/sra/1")
    assert tuple(got[1]) == ("s3://b/k/x", "https://b.s3.amazonaws.com/k/x")
    assert got[2] is None and got[3] is None


def test_file_type_and_upload_key(spark):
    names = ["a.fastq.gz", "a.fq.gz", "a.bam", "a.cram", "a.vcf", "a.vcf.gz", "a.txt"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(file_type("n")).collect()] == ["fastq", "fastq", "bam", "cram", "vcf", "vcf",
                                                                  "fastq"]
    df = spark.createDataFrame([(None, "f"), ("", "f"), ("p//", "f"), ("p/q", "f")], "p string, n string")
    assert [r[0] for r in df.select(upload_key("p", "n")).collect()] == ["f", "/f", "p/f", "p/q/f"]


def test_relative_key_and_stage_percent(spark):
    assert one(spark, relative_key(F.col("v"), F.lit("2026/")), "2026/nt.1") == "nt.1"
    assert one(spark, relative_key(F.col("v"), F.lit("2026/")), "other/nt.1") == "other/nt.1"
    df = spark.createDataFrame([(50, 100, False), (100, 100, False), (100, 100, True), (5, 0, False)],
                               "d long, t long, f boolean")
    got = [r[0] for r in df.select(stage_percent("d", "t", F.col("f"))).collect()]
    assert got == [50.0, 99.0, 100.0, 0.0]


def test_stamps(spark):
    from datetime import datetime
    from tidemark.functions.columns import file_stamp, header_stamp
    df = spark.createDataFrame([(datetime(2026, 7, 17, 13, 32, 27),)], "t timestamp_ntz")
    r = df.select(file_stamp("t").alias("f"), header_stamp("t").alias("h")).first()
    assert (r["f"], r["h"]) == ("2026-07-17_13-32-27", "2026-07-17 13:32:27")
