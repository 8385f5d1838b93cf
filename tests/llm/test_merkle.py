"""Proofs by pointer jumping against a tree built in Python, and against SQL."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
COLS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, text, lang, source, n_chars):
    return h(*map(field, (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """(root, siblings and places per level of every node)"""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at):
            run = nodes[i - i % 16:i - i % 16 + 16]
            p.append(("".join(run[:i % 16]), "".join(run[i % 16 + 1:])))
        nodes, at = [h(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)], [i // 16 for i in at]
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found, subs = [], []
    for s in order:
        rs = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        sub, paths = climb([leaf(*r) for r in rs])
        subs.append(sub)
        found += [(r, sub, p, len(subs) - 1) for r, p in zip(rs, paths)]
    root, tops = climb(subs) if subs else (None, [])
    out = []
    for r, sub, path, at in found:
        path = path + tops[at]
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
        f = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if hit else r[1], *r[2:])
        for a, b in path:
            f = h(a, f, b)
        out.append((r[0] if r[0] is not None else -1, leaf(*r), sub, root, h(*[x for s in path for x in s]), f, f == root))
    return sorted(out)


def run(spark, df, monkeypatch, tmp_path):
    monkeypatch.setattr(queries, "read", lambda *_: df)
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in queries.QUERIES["op12_merkle_manifest"](spark, "").select(COLS).collect())


def test_plain_tree(spark, odd_docs, monkeypatch, tmp_path):
    rows = [tuple(r) for r in odd_docs.collect()]
    assert run(spark, odd_docs, monkeypatch, tmp_path) == plain(rows)


@pytest.mark.parametrize("broadcast", [merkle.BROADCAST_BYTES, 0])
def test_deep_trees_and_many_sources(spark, monkeypatch, tmp_path, broadcast):
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", broadcast)
    rows = [(i, f"Text {i % 7}", "en", "hot", i) for i in range(4200)] + [(i, "T", None, f"s{i % 40}", None) for i in range(5000, 5600)]
    rows += [(6000 + i, None, "de", n, 1) for i, n in enumerate(["", "ä", "Z", None])] + [(1, "Text 1", "en", "hot", 1)] * 40
    assert run(spark, spark.createDataFrame(rows, DOCS).repartition(6), monkeypatch, tmp_path) == plain(rows)


@pytest.mark.parametrize("n", [1, 16, 17, 257])
def test_one_source(spark, monkeypatch, tmp_path, n):
    rows = [(i, "One Text", "en", "a", 8) for i in range(n)]
    assert run(spark, spark.createDataFrame(rows, DOCS), monkeypatch, tmp_path) == plain(rows)


def test_empty_and_clashing_columns(spark, odd_docs, no_docs, monkeypatch, tmp_path):
    assert run(spark, no_docs, monkeypatch, tmp_path) == []
    clash = odd_docs.select("*", F.lit(1).alias("scope"), F.lit(2).alias("POS"), F.lit("x").alias("digest"), F.lit(0).alias("DOC_ID"), F.lit(0).alias("items"))
    assert run(spark, clash, monkeypatch, tmp_path) == plain([tuple(r) for r in odd_docs.collect()])


def test_proofs_fold_to_the_root_and_catch_changes(spark, odd_docs):
    found = merkle.proofs(odd_docs, altered=lambda f: f | {"lang": F.concat(F.coalesce(f["lang"], F.lit("")), F.lit("!"))})
    got = found.select("root", merkle.fold(F.col("leaf"), F.col("proof")).alias("a"), merkle.fold(F.col("altered_leaf"), F.col("proof")).alias("b")).collect()
    assert len(got) == 11 and all(r["a"] == r["root"] != r["b"] for r in got)


def test_query_matches_sql(spark, con):
    got = sorted(tuple(r[c] for c in COLS) for r in queries.QUERIES["op12_merkle_manifest"](spark, "/root/testdata/sf0.001").collect())
    res = con.execute(queries.ORACLE["op12_merkle_manifest"])
    names = [d[0] for d in res.description]
    assert got == sorted(tuple(r[names.index(c)] for c in COLS) for r in res.fetchall()) and got
