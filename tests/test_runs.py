"""Run-report processing traps."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.filters import PatternError, java_regex, preview_keep, regex_filter, selected_counts
from tidemark.operators.runs import capacity_plan, process_runs
from tidemark.plans.resume import file_tasks
from tidemark.sinks.tables import dry_run_plan, mate_checksum_rows

COLS = "run_accession string, sample_title string, fastq_ftp string, fastq_md5 string, fastq_bytes string"


def runs(spark, rows):
    return spark.createDataFrame(rows, COLS)


def test_process_runs_traps(spark):
    df = runs(spark, [
        ("R1", "s", "h/R1_1.fq;h/R1_2.fq", "m1;m2", "n/a;20"),          # bad first size shifts
        ("R2", None, "h/R2.fq;h/R2_1.fq;h/R2_2.fq", "a;b;c", "1;2;3"),  # three files: first two win
        ("R3", "t", "h/R3_1.fq;h/R3_2.fq", "only", "5;6"),             # one md5: no mate 2
        ("R4", "t", "", "x", "1"),                                     # no url: dropped
        ("R5", "t", "h/R5.fq", "m", ""),                               # size defaults to 0
    ])
    got = {r["run_accession"]: r for r in process_runs(df).collect()}
    assert set(got) == {"R1", "R2", "R3", "R5"}
    assert got["R1"]["fastq_bytes_1"] == 20 and got["R1"]["fastq_bytes_2"] is None
    assert got["R2"]["fastq_ftp_1_name"] == "R2.fq" and got["R2"]["fastq_ftp_2_name"] == "R2_1.fq"
    assert got["R2"]["sample_title"] == ""
    assert got["R3"]["fastq_ftp_2_url"] is None and got["R3"]["fastq_md5_2"] is None
    assert got["R5"]["fastq_bytes_1"] == 0
    aligned = {r["run_accession"]: r for r in process_runs(df, aligned_sizes=True).collect()}
    assert aligned["R1"]["fastq_bytes_1"] is None or aligned["R1"]["fastq_bytes_1"] == 0
    assert aligned["R1"]["fastq_bytes_2"] == 20


def test_pe_only_counts_urls_not_layout(spark):
    df = runs(spark, [("R1", "", "a;b", "m;n", "1;2"), ("R2", "", "a", "m", "1")])
    assert [r[0] for r in process_runs(df, pe_only=True).select("run_accession").collect()] == ["R1"]


def test_mate_two_rules(spark):
    # size of mate 2 missing: checksum TSV keeps mate 2, dry run and file tasks drop it
    df = runs(spark, [("R1", "t", "h/a_1;h/a_2", "m1;m2", "10")])
    p = process_runs(df)
    assert mate_checksum_rows(p).count() == 2
    assert dry_run_plan(p).count() == 1
    assert file_tasks(p).count() == 1


def test_regex_filter_semantics(spark):
    df = runs(spark, [("SRR1", "liver ٣", "", "", ""), ("SRR2", "Liver", "", "", ""), ("ERR3", None, "", "", "")])
    # unanchored, case-sensitive; \d is Unicode-aware; a null title is ''
    assert [r[0] for r in regex_filter(df, include_sample=[r"\d"]).select("run_accession").collect()] == ["SRR1"]
    assert regex_filter(df, include_sample=["liver"]).count() == 1
    assert regex_filter(df, exclude_sample=["^$"]).count() == 2
    assert regex_filter(df, include_run=["^SRR"], exclude_run=["2"]).count() == 1


def test_regex_dialect_checked_on_driver():
    with pytest.raises(PatternError):
        java_regex("(?=x)a")
    with pytest.raises(PatternError):
        java_regex(r"(a)\1")
    with pytest.raises(PatternError):
        java_regex("(unclosed")


def test_preview_filter_case_insensitive_and_lenient(spark):
    df = runs(spark, [("SRR1", "Liver", "", "", ""), ("SRR2", "kidney", "", "", "")])
    r = selected_counts(df, preview_keep(filter_sample=" LIVER ,\n")).first()
    assert (r["selected"], r["total"]) == (1, 2)
    r = selected_counts(df, preview_keep(filter_sample="(bad")).first()
    assert (r["selected"], r["total"]) == (2, 2)


def test_capacity_plan(spark):
    df = runs(spark, [("R1", "", "a;b", "m;n", "10;20"), ("R2", "", "c", "m", "5")])
    r = capacity_plan(process_runs(df)).first()
    assert r["runs"] == 2 and int(r["planned_bytes"]) == 35 and r["expanded_bytes"] == 105.0


def test_regex_dialects(spark):
    df = spark.createDataFrame([("LIVERx", "R1"), ("liver", "R2"), ("abba", "R3")], "sample_title string, run_accession string")
    kept = lambda **spec: [r["run_accession"] for r in df.where(preview_keep(**spec)).collect()]
    assert kept(filter_sample="liver(?=x)") == ["R1"]
    assert kept(filter_sample=r"(b)\1, zz") == ["R3"] and kept(filter_sample=r"zz, (b)\1") == ["R3"]
    assert kept(filter_sample="(?i)liver") == ["R1", "R2", "R3"]  # not valid there: every row stays
