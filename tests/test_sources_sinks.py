"""Sources and sinks: TSV reports (quoting, headers, comments), catalogue
YAML, progress export decryption, gzip round trip, templates."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators.catalog import known_names, lookup_catalog, match_catalog, missing_parts, volumes
from tidemark.operators.filters import lint_catalog
from tidemark.schemas import RUN_REPORT_COLUMNS
from tidemark.sinks.writers import export_progress, write_gzip_text, write_mate_checksums, write_run_report
from tidemark.sources.catalog import CatalogError, load_catalog
from tidemark.sources.runs import read_accession_reports, read_run_report
from tidemark.sources.state import parse_progress

YAML = """
software:
  blastdbcmd: /opt/bin/blastdbcmd
public_data:
  ncbi_nt:
    s3_url: s3://ncbi-blast-databases/2026-07-10/
    description: "NCBI nt database"
    database_type: folder
    exclude: "*"
    include: "nt.*"
  ncbi_nr:
    s3_url: s3://ncbi-blast-databases/2026-06-16/
    description: "NCBI nr database"
    db_type: folder
    validate:
      enabled: true
      tool: blastdbcmd
      dbtype: prot
  taxdb:
    s3_url: s3://ncbi-blast-databases/2026-07-10/taxdb.tar.gz
    description: "taxonomy"
    database_type: file
    validate:
      enabled: true
      tool: other
      dbtype: nucl
      max_retries: 5
"""


def test_catalog_yaml_defaults_and_alias(spark):
    cat = load_catalog(spark, YAML)
    got = {r["name"]: r for r in cat.collect()}
    assert got["ncbi_nt"]["validate"] is None and got["ncbi_nt"]["include"] == "nt.*"
    v = got["ncbi_nr"]["validate"]
    assert got["ncbi_nr"]["database_type"] == "folder"
    assert (v["enabled"], v["tool"], v["dbtype"], v["max_retries"], v["retry_delay_seconds"]) == (
        True, "blastdbcmd", "prot", 2, 10)
    issues = {r["name"]: r["issues"] for r in lint_catalog(cat).collect()}
    assert issues["taxdb"] == ["validate.tool must be blastdbcmd"]
    assert issues["ncbi_nt"] == []
    with pytest.raises(CatalogError):
        load_catalog(spark, "public_data:\n  x:\n    description: no url\n")


def test_catalog_match_and_lookup(spark):
    cat = load_catalog(spark, YAML)
    listing = spark.createDataFrame([
        ("ncbi-blast-databases", "2026-07-10/nt.000.nsq", 10, '"d41d8cd98f00b204e9800998ecf8427e"'),
        ("ncbi-blast-databases", "2026-07-10/nt.000.nhr", 11, '"x-2"'),
        ("ncbi-blast-databases", "2026-07-10/taxdb.btd", 3, None),
        ("ncbi-blast-databases", "2026-07-10/sub/", 0, None),
        ("ncbi-blast-databases", "2026-06-16/nr.001.phr", 5, None),
        ("other", "2026-07-10/nt.001.nsq", 9, None),
    ], "bucket string, key string, size long, etag string")
    m = sorted((r["name"], r["key"]) for r in match_catalog(cat, listing).collect())
    # per-row pattern columns (used for very large catalogues) give the same rows
    assert m == sorted((r["name"], r["key"]) for r in match_catalog(cat, listing, max_literal_entries=0).collect())
    assert ("ncbi_nt", "2026-07-10/nt.000.nsq") in m and ("ncbi_nt", "2026-07-10/taxdb.btd") not in m
    assert ("ncbi_nr", "2026-06-16/nr.001.phr") in m
    assert not any(k.endswith("/") for _, k in m)
    req = spark.createDataFrame([("ncbi_nt",), ("nope",)], "name string")
    got = {r["name"]: r for r in lookup_catalog(cat, req).collect()}
    assert got["ncbi_nt"]["found"] and not got["nope"]["found"]
    assert got["nope"]["error"] == "Unknown database 'nope'. Available: 3 databases"
    assert [r["name"] for r in known_names(cat).collect()] == ["ncbi_nr", "ncbi_nt", "taxdb"]
    vol = {r["volume"]: r["n_objects"] for r in volumes(listing.where(F.col("bucket") != "other")).collect()}
    assert vol["nt.000"] == 2
    miss = missing_parts(listing.where(F.col("key").contains("nr.001")))
    assert miss.count() == 9


def test_unknown_name_lists_every_known_name(spark):
    names = [f"db{i:05d}" for i in range(10_002)]  # one more than a broadcast takes, and a repeat
    cat = spark.createDataFrame([(n, "s3://b/p/", "folder") for n in [*reversed(names), "db00003", None]], "name string, s3_url string, database_type string")
    req = spark.createDataFrame([("nope",), ("db00007",)], "name string")
    got = {r["name"]: r["error"] for r in lookup_catalog(cat, req, list_names=True).collect()}
    assert got == {"nope": "Unknown database 'nope'. Available: " + ", ".join(names), "db00007": None}


def test_tsv_roundtrip_with_comment_and_quotes(spark, tmp_path):
    rows = [("SRR1", "title with\ttab and \"quote\"", "a;b", "", None)]
    df = spark.createDataFrame(rows, "run_accession string, sample_title string, fastq_ftp string, fastq_md5 string,"
                                     " scientific_name string")
    path = write_run_report(df, str(tmp_path / "out"), accession="PRJ1")
    assert os.path.isdir(path + "_accession")
    back = read_run_report(spark, path).first()
    assert back["sample_title"] == "title with\ttab and \"quote\""
    assert back["fastq_md5"] == "" and back["fastq_bytes"] == "" and back["scientific_name"] is None
    assert len(read_run_report(spark, path).columns) == len(RUN_REPORT_COLUMNS)


def test_accession_reports_with_different_headers(spark, tmp_path):
    root = tmp_path / "land"
    (root / "PRJA_metadata").mkdir(parents=True)
    (root / "PRJB_metadata").mkdir(parents=True)
    (root / "PRJA_metadata" / "r.tsv").write_text(
        "# Project Accession: PRJA\nrun_accession\tsample_title\textra\nA1\t\"t\tq\"\tx\nA2\t\ty\n")
    (root / "PRJB_metadata" / "r.tsv").write_text("fastq_ftp\trun_accession\nu1;u2\tB1\n")
    got = {r["run_accession"]: r for r in read_accession_reports(spark, str(root)).collect()}
    assert got["A1"]["sample_title"] == "t\tq" and got["A1"]["accession"] == "PRJA"
    assert got["A2"]["sample_title"] == ""
    assert got["B1"]["fastq_ftp"] == "u1;u2" and got["B1"]["sample_title"] == "" and got["B1"]["accession"] == "PRJB"
    (root / "PRJB_metadata" / "bad.tsv").write_text("run_accession\tfastq_ftp\nB2\tu\textra\n")
    with pytest.raises(Exception):
        read_accession_reports(spark, str(root)).collect()


def test_mate_checksum_files(spark, tmp_path):
    from tidemark.operators.runs import process_runs
    df = spark.createDataFrame([("R1", "s1", "h/a_1.fq;h/a_2.fq", "m1;m2", "1;2"), ("R2", "s2", "h/b.fq", "m3", "3")],
                               "run_accession string, sample_title string, fastq_ftp string, fastq_md5 string,"
                               " fastq_bytes string")
    r1, r2 = write_mate_checksums(process_runs(df), str(tmp_path), "PRJ1")
    assert r1.endswith("R1_fastq_md5_PRJ1.tsv")
    assert spark.read.option("sep", "\t").csv(r1).count() == 2 and spark.read.option("sep", "\t").csv(r2).count() == 1


def test_progress_export_decrypts(spark):
    key = "00112233445566778899aabbccddeeff00112233445566778899aabbccddeeff"
    st = "struct<bytes_done: bigint, bytes_total: bigint, weight: double, percent: double>"
    prog = spark.sql(f"""SELECT 'SRR1' AS run_id, 'downloading' AS stage, 12.5D AS overall_percent,
        named_struct('bytes_done', 5L, 'bytes_total', 10L, 'weight', 1D, 'percent', 50D) AS download,
        cast(null AS {st}) AS extraction, cast(null AS {st}) AS compression""")
    plain = export_progress(prog).first()["json"]
    enc = export_progress(prog, key_hex=key)
    dec = enc.select(F.aes_decrypt(F.concat(F.unbase64("nonce"), F.unbase64("ciphertext")),
                                   F.unhex(F.lit(key)), F.lit("GCM")).cast("string").alias("j")).first()["j"]
    assert dec == plain
    back = parse_progress(spark.createDataFrame([(plain,)], "json string")).first()
    assert back["run_key"] == "SRR1" and back["download_percent"] == 50.0


def test_gzip_roundtrip(spark, tmp_path):
    lines = [("SRR000001_1.fastq", i + 1, l) for i, l in enumerate(["@read1/1", "ACGTACGT", "+", "!!!!!!!!"])]
    lines += [("SRR000001_2.fastq", i + 1, l) for i, l in enumerate(["@read1/2", "TGCATGCA", "+", "!!!!!!!!"])]
    df = spark.createDataFrame(lines, "file string, line_no long, line string")
    out = write_gzip_text(df, str(tmp_path / "gz"))
    for name, want in (("SRR000001_1.fastq", "@read1/1\nACGTACGT\n+\n!!!!!!!!\n"),
                       ("SRR000001_2.fastq", "@read1/2\nTGCATGCA\n+\n!!!!!!!!\n")):
        d = os.path.join(out, f"file={name}")
        parts = sorted(p for p in os.listdir(d) if p.endswith(".gz"))
        text = "".join(gzip.open(os.path.join(d, p), "rt").read() for p in parts)
        assert text == want


def test_read_progress_snapshot_file(spark, tmp_path):
    import json as _json
    from tidemark.sources.state import read_progress
    st = {"bytes_done": 5, "bytes_total": 10, "weight": 1.0, "percent": 50.0}
    doc = {"SRR1": {"run_id": "SRR1", "stage": "compressing", "overall_percent": 78.57, "download": st,
                    "extraction": st, "compression": st},
           "SRR2": {"run_id": "SRR2", "stage": "pending", "overall_percent": 0.0, "download": st,
                    "extraction": st, "compression": st}}
    p = tmp_path / "progress.json"
    p.write_text(_json.dumps(doc, indent=2))
    got = {r["run_key"]: r for r in read_progress(spark, str(p)).collect()}
    assert got["SRR1"]["stage"] == "compressing" and got["SRR2"]["download_percent"] == 50.0
    lines = tmp_path / "lines.json"
    lines.write_text("\n".join(_json.dumps({k: v}) for k, v in doc.items()))
    assert read_progress(spark, str(lines), json_lines=True).count() == 2


def test_gzip_text_files_skip_missing_and_empty(spark, tmp_path):
    from tidemark.sinks.writers import gzip_text_files
    src = tmp_path / "fq"
    src.mkdir()
    (src / "SRR1_1.fastq").write_text("@r/1\nACGT\n+\n!!!!\n")
    (src / "SRR1_2.fastq").write_text("")
    out = gzip_text_files(spark, str(src / "SRR1*.fastq"), str(tmp_path / "gz"))
    made = sorted(p for p in os.listdir(out) if p.startswith("file="))
    assert made == ["file=SRR1_1.fastq"]
    d = os.path.join(out, made[0])
    text = "".join(gzip.open(os.path.join(d, p), "rt").read() for p in sorted(os.listdir(d)) if p.endswith(".gz"))
    assert text == "@r/1\nACGT\n+\n!!!!\n"


def test_many_accessions_in_one_write(spark, tmp_path):
    from tidemark.sinks.writers import ACCESSION_DIR, write_run_reports
    df = spark.createDataFrame([("R1", "t1", "P1"), ("R2", "t2", "P1"), ("R3", "t3", "P2")],
                               "run_accession string, sample_title string, accession string")
    out = write_run_reports(df, str(tmp_path / "reports"))
    back = read_accession_reports(spark, out, pattern=ACCESSION_DIR)
    got = sorted((r["accession"], r["run_accession"], r["sample_title"]) for r in back.collect())
    assert got == [("P1", "R1", "t1"), ("P1", "R2", "t2"), ("P2", "R3", "t3")]


def test_report_with_newline_in_quoted_field(spark, tmp_path):
    from tidemark.sources.runs import read_run_report_csv
    p = tmp_path / "r.tsv"
    p.write_text('run_accession\tsample_title\nR1\t"two\nlines"\nR2\tplain\n')
    got = {r["run_accession"]: r["sample_title"] for r in read_run_report_csv(spark, str(p), multiline=True).collect()}
    assert got == {"R1": "two\nlines", "R2": "plain"}


def test_failed_volumes_manifest_file_order(spark, tmp_path):
    from tidemark.sinks.writers import write_failed_volumes
    f = spark.createDataFrame([("nt.001", "Volume nt.001 failed", "s3://b/nt.001.psq"),
                               ("nt.001", "Volume nt.001 failed", "s3://b/nt.001.phr"),
                               ("nr.000", "tool error", "s3://b/nr.000.pin"), ("nr.001", "gone", None)],
                              "volume string, error string, uri string")
    out = write_failed_volumes(f, str(tmp_path / "failed"), "2026-07-17 13:32:27", "ncbi_nt")
    text = "".join(open(os.path.join(out, p)).read() for p in sorted(os.listdir(out)) if p.startswith("part"))
    assert text.splitlines() == [
        "# Failed volumes for ncbi_nt", "# Generated at 2026-07-17 13:32:27", "# Total: 3", "",
        "[volume: nr.000]", "# error: tool error", "s3://b/nr.000.pin", "",
        "[volume: nr.001]", "# error: gone", "",
        "[volume: nt.001]", "# error: Volume nt.001 failed", "s3://b/nt.001.phr", "s3://b/nt.001.psq", ""]


def test_submission_template_file(spark, tmp_path):
    from tidemark.operators.filters import upload_candidates
    from tidemark.schemas import SUBMISSION_COLUMNS
    from tidemark.sinks.writers import write_submission_template
    inv = spark.createDataFrame([("/in/a.fq.gz", 10), ("/in/b.bam", 0), ("/in/c.vcf", 3)], "path string, length long")
    ok = upload_candidates(inv).where(F.col("accepted"))
    out = write_submission_template(ok, str(tmp_path / "tpl"), "bkt", "runs/")
    back = spark.read.option("sep", "\t").option("header", True).csv(out)
    assert back.columns == SUBMISSION_COLUMNS
    got = sorted((r["filename"], r["filetype"], r["s3_path"]) for r in back.collect())
    assert got == [("a.fq.gz", "fastq", "s3://bkt/runs/a.fq.gz"), ("c.vcf", "vcf", "s3://bkt/runs/c.vcf")]


def test_report_round_trip_with_newlines_and_a_long_quoted_field(spark, tmp_path, capsys):
    from tidemark.sinks.writers import write_run_report
    titles = {"R1": "two\nlines and a\ttab", "R2": 'say "hi"', "R3": "#not a comment", "R4": "x\t" * 500_000 + "end", "R5": "\n# inside\n"}
    runs = spark.createDataFrame([(k, v) for k, v in titles.items()], "run_accession string, sample_title string")
    path = write_run_report(runs, str(tmp_path / "out"), accession="PRJ1")
    back = read_run_report(spark, path)
    assert {r["run_accession"]: r["sample_title"] for r in back.select("run_accession", "sample_title").collect()} == titles
    # a report without open quotes: its lines meet only broadcast tables
    plain = runs.where("run_accession = 'R2'")
    read_run_report(spark, write_run_report(plain, str(tmp_path / "plain"))).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin [" not in plan and "Arrow" not in plan and plan.count("FileScan text") == 1
    assert plan.count("Exchange hashpartitioning(file") == 1  # the table of blocks, one row each


TITLES = ['5" y', "two\nlines", 'a "quoted" word', "tab\there", "", "\n\n# not a comment\n", "#3", 'x"', '"', "é\r\nü", "plain", '""', "ends in a tab\t"]


def write_tsv(path, rows, quote_all=False):
    def field(x):
        bare = x is not None and (x.startswith('"') or any(c in x for c in "\t\n\r"))
        return '"' + x.replace('"', '""') + '"' if bare or quote_all else x or ""
    path.write_bytes("".join("\t".join(map(field, r)) + "\n" for r in rows).encode())


def test_a_report_is_split_in_the_middle_of_fields(spark, tmp_path, monkeypatch):
    """Blocks of a few bytes and chunks of a few lines: the rows are those of a reader that sees the whole."""
    import csv
    import io

    from tidemark.sources import reports
    rows = [(f"R{i}", TITLES[i % len(TITLES)], str(i)) for i in range(400)]
    p = tmp_path / "r.tsv"
    write_tsv(p, [("run_accession", "sample_title", "fastq_bytes"), *rows])
    p.write_bytes(b"# Project Accession: \"P\n\n" + p.read_bytes().replace(b"R7\t", b"# a comment\n\nR7\t", 1) + b'R400\t"ab"cd\t1\n')
    want = sorted([(r, t or "", b) for r, t, b in rows] + [("R400", "abcd", "1")])
    lines = io.StringIO(p.read_text(), newline="")
    assert len([r for r in csv.reader((x for x in lines if not x.startswith("# Project")), delimiter="\t")]) > 400  # a plain reader's view of the file
    for block, chunk in ((1 << 27, reports.CHUNK_LINES), (700, 7), (64, 1)):
        monkeypatch.setattr(reports, "CHUNK_LINES", chunk)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            back = read_run_report(spark, str(p))
            assert sorted(map(tuple, back.select("run_accession", "sample_title", "fastq_bytes").collect())) == want, (block, chunk)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_bad_records_fail_or_are_kept_aside(spark, tmp_path):
    from tidemark.sources.runs import report_rejects
    (tmp_path / "a.tsv").write_text('run_accession\tsample_title\nR1\tok\nR2\nR3\ta\rb\nR4\t"a\nb"\textra\nR5\tok\n')
    (tmp_path / "b.tsv").write_text('run_accession\tsample_title\nR6\tok\nR7\t"never closed\nR8\tlost\n')
    (tmp_path / "c.tsv").write_text("run_accession\trun_accession\nR9\tx\n")
    (tmp_path / "d.tsv").write_bytes("\ufeffrun_accession\tsample_title\r\nR10\tcr\r\n".encode())
    (tmp_path / "e.tsv").write_text("")
    good = read_run_report(spark, str(tmp_path), mode="quarantine")
    assert sorted(r["run_accession"] for r in good.collect()) == ["R1", "R10", "R5", "R6"]
    bad = [(r["source"][-5], r["line_no"], r["reason"].split(" of ")[0].split(" in ")[0]) for r in report_rejects(spark, str(tmp_path)).collect()]
    assert sorted(bad) == [("a", 3, "ragged row at line 3"), ("a", 4, "bare carriage return at line 4"), ("a", 6, "ragged row at line 6"),
                           ("b", 3, "a quote opened at line 3"), ("c", 2, "a column named twice")]
    for name in "abc":
        with pytest.raises(Exception):
            read_run_report(spark, str(tmp_path / f"{name}.tsv")).collect()
    with pytest.raises(ValueError):
        read_run_report(spark, str(tmp_path), mode="skip")


def test_rejects_of_the_other_parsers(spark):
    from tidemark.operators.progress import log_rejects, parse_log_lines
    from tidemark.sources.locators import extract_locators, locator_rejects
    from tidemark.sources.manifest import manifest_rejects
    from tidemark.sources.state import parse_chunk_state, parse_progress, progress_rejects, state_rejects
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    state = rows([("a", '{"downloaded_chunks":[1]}'), ("b", "no"), ("c", '{"downloaded_chunks":[-1]}'), ("d", '{"x":1}')], "file_id string, state_json string")
    progress = rows([('{"R":{"run_id":"R","stage":"pending"}}',), ("[1",), ("{ }",)], "json string")
    log = rows([("[2024-01-01 00:00:00.000] [INFO] x",), ("junk",), (None,)], "line string")
    xml = rows([("R1", "<RUN_SET><RUN/></RUN_SET>"), ("R2", "<RUN_SET><RUN></RUN_SET>"), ("R3", "")], "run_id string, xml string")
    lines = rows([("f", 1, "0" * 32 + "  ok"), ("f", 2, " zz  bad "), ("f", 3, "# c")], "file string, line_no long, value string")
    found = lambda df: sorted((r["source"] or "", r["line_no"], r["line"]) for r in df.collect())
    shape = ["source", "line_no", "line", "reason"]
    every = [state_rejects(state), progress_rejects(progress), log_rejects(log), locator_rejects(xml), manifest_rejects(lines)]
    assert all(d.columns == shape for d in every)
    assert [r[0] for r in found(every[0])] == ["b", "c", "d"] and [r[2] for r in found(every[1])] == ["[1"] and every[2].count() == 2
    assert [r[0] for r in found(every[3])] == ["R2", "R3"] and found(every[4]) == [("f", 2, "zz  bad")]
    for parse, df in ((parse_chunk_state, state), (parse_progress, progress), (parse_log_lines, log), (extract_locators, xml)):
        parse(df).collect()
        with pytest.raises(Exception):
            parse(df, mode="fail").collect()


def test_tags_of_any_length(spark):
    """Long tags, many attributes and hostile quotes: no stack that grows with the tag."""
    from tidemark.sources.locators import extract_locators
    alt = '<Alternatives org="AWS" free_egress="worldwide" url="https://b.s3.amazonaws.com/k"/>'
    docs = [f'<RUN {"x" * 200_000}><SRAFile md5="m1" size="5">{alt}</SRAFile></RUN>',
            "<RUN " + " ".join(f'a{i}="v>{i}"' for i in range(20_000)) + f'><SRAFile md5="m2" size="6">{alt}</SRAFile></RUN>',
            f"<RUN a='{'y' * 300_000}'><SRAFile md5='m3' size='7'>{alt}</SRAFile></RUN>", "<RUN " + "'" * 30_001 + alt]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, xml string")
    got = {r["i"]: (r["md5"], r["size"]) for r in extract_locators(df).collect()}
    assert [got[i] for i in range(3)] == [("m1", 5), ("m2", 6), ("m3", 7)]


def test_ragged_report_fails(spark, tmp_path):
    p = tmp_path / "bad.tsv"
    p.write_text("run_accession\tsample_title\nR1\tok\nR2\n")
    with pytest.raises(Exception, match="ragged row at line 3"):
        read_run_report(spark, str(p)).collect()


def test_catalog_match_joins_on_bucket_and_prefix(spark, capsys):
    cat = spark.createDataFrame([("a", "s3://b/x/", None, None), (None, "s3://b/x/y", None, None), ("c", "s3://b/", "*.md5", None),
                                 ("d", "s3://other/x/", None, None)], "name string, s3_url string, exclude string, include string")
    lst = spark.createDataFrame([("b", k, 5, None) for k in ("x/y1", "x/z", "w.md5", "w")], "bucket string, key string, size long, etag string")
    want = sorted([("a", "x/y1"), ("a", "x/z"), ("None", "x/y1"), ("c", "x/y1"), ("c", "x/z"), ("c", "w")])
    for literal in (256, 0):
        got = match_catalog(cat, lst, max_literal_entries=literal)
        assert sorted((str(r["name"]), r["key"]) for r in got.collect()) == want
    got.explain()
    plan = capsys.readouterr().out
    assert "_cut" in plan and "StartsWith(key" not in plan


def test_decisions_do_not_fan_out_on_repeated_names(spark):
    from tidemark.operators.checksum import check_integrity
    from tidemark.plans.resume import ftp_decision, locate_runs, resume_decision
    from tidemark.sources.listing import lookup_objects
    remote = spark.createDataFrame([("f", 5, "m")], "file_id string, size long, md5 string")
    local = spark.createDataFrame([("f", 3, "x"), ("f", 5, "m")], "file_id string, local_size long, local_md5 string")
    state = spark.createDataFrame([("f", 0), ("f", 1)], "file_id string, chunk_id long")
    assert [r["decision"] for r in resume_decision(remote, local, state).collect()] == ["RESUME"]
    assert [r["valid"] for r in check_integrity(remote, local).collect()] == [True]
    tasks = spark.createDataFrame([("n", 5, "m")], "filename string, total_size long, md5 string")
    assert [r["decision"] for r in ftp_decision(tasks, local.withColumnRenamed("file_id", "filename").withColumn("filename", F.lit("n"))).collect()] == ["SKIP"]
    runs = spark.createDataFrame([("R",), ("S",)], "run_id string")
    loc = spark.createDataFrame([("R", "s3://a"), ("R", "s3://b")], "run_id string, s3_uri string")
    assert sorted((r["run_id"], r["s3_uri"]) for r in locate_runs(runs, loc).collect()) == [("R", "s3://b"), ("S", None)]
    lst = spark.createDataFrame([("b", "k", None, None), ("b", "k", 4, None)], "bucket string, key string, size long, etag string")
    req = spark.createDataFrame([("b", "k"), ("b", "gone"), ("b", "dir/")], "bucket string, key string")
    assert sorted((r["key"], r["status"]) for r in lookup_objects(lst, req).collect()) == [("dir/", "bad key"), ("gone", "missing"), ("k", "found")]


def test_locators_are_found_in_one_pass_over_the_tags(spark):
    """A filter on the result evaluates the document's tags once, not once per use."""
    from tidemark.sources.locators import extract_locators
    aws = '<Alternatives org="aws" free_egress="WorldWide" url="{}"/>'
    docs = [None, "", "<Run md5='r' size='7'>" + aws.format("") + aws.format("s3://b/k") + aws.format("s3://b/z") + "</Run>",
            aws.format("https://b.s3.amazonaws.com/k") + "<SRAFile md5='late'/>", '<SRAFile md5="m" size="x"/>' + aws.format("ftp://no") + "<Run/>" + aws.format("s3://c/k")]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, xml string")
    found = extract_locators(df).where(F.col("s3_uri").isNotNull())
    got = {r["i"]: (r["s3_uri"], r["http_url"], r["md5"], r["size"]) for r in found.collect()}
    assert got == {2: ("s3://b/k", "https://b.s3.amazonaws.com/k", "r", 7), 3: ("s3://b/k", "https://b.s3.amazonaws.com/k", None, 0),
                   4: ("s3://c/k", "https://c.s3.amazonaws.com/k", None, 0)}
    assert extract_locators(df).where(F.col("s3_uri").isNull()).count() == 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_report_records_are_cut_once(spark, tmp_path):
    """Header checks are made per file, a record's fields taken by their places."""
    from tidemark.sources.runs import read_accession_reports
    for acc, text in (("A", "sample_title\trun_accession\tother\r\nt\tR1\tx\r\n\tR2\t\r\n"), ("B", 'run_accession\nR3\n"R\t""4"\n')):
        (tmp_path / f"{acc}_metadata").mkdir()
        (tmp_path / f"{acc}_metadata" / "r.tsv").write_bytes(text.encode())
    df = read_accession_reports(spark, str(tmp_path)).select("accession", "run_accession", "sample_title", "library_layout")
    assert sorted(tuple(r) for r in df.collect()) == [("A", "R1", "t", None), ("A", "R2", "", None), ("B", 'R\t"4', "", None), ("B", "R3", "", None)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_arrays" not in plan and plan.count("regexp_extract_all(") == 2  # headers and records, each cut at one place
    (tmp_path / "C_metadata").mkdir()
    (tmp_path / "C_metadata" / "r.tsv").write_text("run_accession\trun_accession\nR5\tR6\n")
    with pytest.raises(Exception, match="named twice"):
        read_accession_reports(spark, str(tmp_path)).select("run_accession").collect()
