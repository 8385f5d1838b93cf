"""Mixing against SQL and against a plain computation."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, queries
from tidemark.llm.common import word_count

from .conftest import DOCS, SMALL


def targets(sizes):
    """Targets by sharing, stopping and sharing again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, rest = 1.5 * sum(sizes.values()), {}, set(names)
    while rest:
        total = sum(weight[s] for s in rest)
        over = {s for s in rest if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in rest}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        rest -= over
    return out


def test_query_matches_sql(spark, con):
    got = queries.QUERIES["op4_mix_sources"](spark, SMALL)
    names = ["doc_id", "size", "source_size", "target", "taken"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.ORACLE["op4_mix_sources"]).fetchall())


def test_targets_and_totals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    rows = mixing.plan_table(docs).collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    assert {r["id"]: r["size"] for r in rows} == size
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes = Counter()
    for d, n in size.items():
        sizes[source[d]] += n
    want, taken = targets(sizes), Counter()
    for r in rows:
        assert r["target"] == pytest.approx(want[source[r["id"]]]) and r["source_size"] == sizes[source[r["id"]]]
        assert 0 <= r["copies"] <= 2
        taken[source[r["id"]]] += r["copies"] * r["size"]
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.25)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.05)
    assert sorted(map(str, mixing.plan_table(docs.repartition(5)).collect())) == sorted(map(str, rows))


def test_hot_small_and_many_sources(spark):
    sizes = {None: 7, "": 5, "a": 900_000, "b": 10, "c": 0} | {f"s{i:03d}": 1 + i % 13 for i in range(300)}
    df = spark.createDataFrame([*sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes))
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_odd_rows(spark, odd_docs, no_docs):
    clash = odd_docs.withColumns({"mix": F.lit(1), "SIZE": F.lit(2), "pos": F.lit(3), "w": F.lit(4)})
    rows = mixing.plan_table(clash).collect()
    assert len(rows) == 11 and {r["id"]: r["size"] for r in rows if r["id"] in (3, 4, 6, 7)} == {3: 0, 4: 0, 6: 0, 7: 3}
    mixed = mixing.mix(clash)
    assert mixed.columns == clash.columns
    want = Counter({r["id"]: 0 for r in rows})
    for r in rows:
        want[r["id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +want
    assert mixing.plan_table(no_docs).collect() == [] and mixing.mix(no_docs).collect() == []
    blank = spark.createDataFrame([(1, None, None, None, None), (2, "", None, "a", 0)], DOCS)
    assert [(r["size"], r["target"], r["copies"]) for r in mixing.plan_table(blank).collect()] == [(0, 0.0, 0)] * 2


def test_repeated_rows_come_near_the_target(spark):
    text = "one two three"
    rows = [(None, text, "en", "a", 13)] * 50 + [(7, text, "en", "b", 13)] * 41 + [(i, text, "en", "c", 13) for i in range(100, 103)] + [(None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    plan = mixing.plan_table(docs).collect()
    taken, want, times = Counter(), {}, {}
    for r in plan:
        taken[r["source_size"]] += r["copies"] * r["size"]
        want[r["source_size"]] = r["target"]
        times.setdefault(r["source_size"], set()).add(r["copies"])
    assert abs(taken[150] - want[150]) <= 3 and abs(taken[123] - want[123]) <= 3
    assert all(max(t) - min(t) <= 1 for t in times.values())
    assert Counter(map(tuple, mixing.plan_table(docs.repartition(7)).collect())) == Counter(map(tuple, plan))
    assert mixing.mix(docs).count() == sum(r["copies"] for r in plan)


def test_word_count(spark):
    texts = ["a b", " a\tb\x0bc\x0cd\re\nf ", "", None, "one", "a\u00a0b c\u2003d", " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [2, 6, 0, 0, 1, 2, 0]
