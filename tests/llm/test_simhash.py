"""SimHash near-dedup against a brute-force version."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import queries, simhash
from tidemark.llm.common import components

from .conftest import SMALL


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, bits=2):
    """Class (smallest place) of each fingerprint, every pair compared."""
    a, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= bits) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [fingerprint(r["text"]) for r in docs]
    want = {r["doc_id"]: (f"{f:016x}", docs[c]["doc_id"]) for r, f, c in zip(docs, fps, classes(fps))}
    got = queries.QUERIES["op1_simhash_near_dedup"](spark, SMALL).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want and len(got) == len(docs)


def test_odd_rows(spark, odd_docs, no_docs):
    got = [tuple(r) for r in simhash.classes(odd_docs.withColumns({"fp": F.lit(1), "ID": F.lit(2), "component": F.lit(3)})).collect()]
    same = {r[1] for r in got if r[0] in (1, 2)}
    assert len(got) == 11 and len(same) == 1 and all(r[2] == 1 for r in got if r[1] in same)
    assert sorted((r[0] or 0, r[2]) for r in got if r[1] == 0) == [(0, 3), (0, 3), (3, 3), (4, 3), (6, 3)]
    assert simhash.classes(no_docs).collect() == [] and simhash.drop_near_copies(no_docs).collect() == []
    clash = odd_docs.withColumns({"row_no": F.lit(1), "odd": F.lit(2), "fp": F.lit(0), "root": F.lit(4)})
    kept = simhash.drop_near_copies(clash)
    assert kept.columns == clash.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 7]


def test_a_class_without_ids_and_repeated_ids_keep_one_row(spark):
    rows = [(None, "a b c"), (None, "a b c"), (8, "x y z"), (8, "x y z"), (8, "p q r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in simhash.drop_near_copies(docs).collect()))) == ["(8, 'p q r')", "(8, 'x y z')", "(None, 'a b c')"]


def test_links_with_hot_buckets_equal_all_pairs(spark):
    """Thousands of fingerprints that share most blocks: finer blocks take over, and no link is lost."""
    rng, base = random.Random(4), 0x0123456789ABCDEF
    fps = {base}
    while len(fps) < 2500:
        x = rng.choice((base, base ^ 0xFFFF))
        for _ in range(rng.choice((1, 3, 4, 5, 9))):
            x ^= 1 << rng.randrange(24)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(nodes)).collect()}
    want = classes([f % (1 << 64) for f in fps])
    members = {}
    for f, c in zip(fps, want):
        members.setdefault(c, []).append(f)
    assert {f: found.get(f, f) for f in fps} == {f: min(m) for m in members.values() for f in m}


def test_components_of_a_long_chain(spark):
    chain = list(range(200))
    random.Random(1).shuffle(chain)
    edges = spark.createDataFrame([*zip(chain, chain[1:]), (500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {n: 0 for n in range(200)} | {500: 500, 501: 500}
    assert components(edges.limit(0)).collect() == []
