"""Decontamination against alignment of every piece with every text."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import decontam, queries

from .conftest import SMALL


def holds(index, text):
    """Items of which some piece is within its budget of some stretch: full alignment, no filter."""
    c, out = decontam.plain(text)[0], set()
    ramp = np.arange(len(c) + 1)
    for p, item, k in zip(index.pieces, index.item, index.k):
        d = np.zeros(len(c) + 1, np.int64)
        for ch in p.tolist():
            new = d + 1
            new[1:] = np.minimum(new[1:], d[:-1] + (c != ch))
            d = np.minimum.accumulate(new - ramp) + ramp
        if d.min() <= k:
            out.add(item)
    return out


def test_edited_passages_equal_full_alignment(spark):
    rng = random.Random(3)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").collect()][:10]
    texts = [r["text"][:1200] for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(50).collect()]
    for _ in range(40):
        i, w = rng.randrange(len(texts)), list(rng.choice(items)[1])
        for _ in range(int(len(w) * rng.choice([0, 0.02, 0.05, 0.08, 0.12]))):
            j = rng.randrange(len(w))
            w[j:j + 1] = rng.choice([[], ["x"], [w[j], "q"]])
        at = rng.randrange(len(texts[i]) + 1)
        texts[i] = f"{texts[i][:at]} {''.join(w)} {texts[i][at:]}"
    index = decontam.Index(items)
    assert [{m[0] for m in x} for x in index.find(texts)] == [holds(index, t) for t in texts]


def test_quotes_at_every_offset(spark):
    rng = random.Random(8)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    items = sorted((i, "".join(map(chr, decontam.plain(x)[0])).strip()) for i, x in items)
    items = [x for x in items if len(x[1]) > 200][:3] + [(-1, " ".join(str(rng.randrange(10 ** 6)) for _ in range(120)))]
    index = decontam.Index(items)
    quotes = [(i, x[a:a + 120]) for i, x in items for a in range(len(x) - 119)]
    found = index.find([f"{rng.randbytes(30).hex()} {q} {rng.randbytes(30).hex()}" for _, q in quotes])
    for (i, q), got in zip(quotes, found):
        assert [m[0] for m in got] == [i] and got[0][3] == 0 and got[0][1] <= 62 and got[0][2] >= 180, q
    edited = []
    for i, q in quotes:
        for at in sorted(rng.sample(range(0, 120, 2), 12), reverse=True):
            q = q[:at] + rng.choice(["ß" + q[at], "é"]) + q[at + 1:]
        edited.append((i, q))
    found = index.find([f"{rng.randbytes(30).hex()} {q} {rng.randbytes(30).hex()}" for _, q in edited])
    assert [[m[0] for m in got] for got in found] == [[i] for i, _ in edited]


def test_query_finds_every_exact_passage(spark):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.QUERIES["op9_benchmark_leaks"](spark, SMALL).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert exact and exact <= found
    plain = lambda s: "".join(map(chr, decontam.plain(s)[0]))
    for r in got:
        if r["distance"] == 0 and (r["doc_id"], r["item_id"]) in exact:
            stretch = docs[r["doc_id"]][r["start"]:r["end"]]
            assert plain(stretch).strip() in plain(items[r["item_id"]]) or plain(items[r["item_id"]]).strip() in plain(stretch)


def test_case_punctuation_and_clean_texts(spark):
    item = "The quick brown fox jumps over the lazy dog while seventy-two geese watch from the frozen river bank in silence."
    loud = "!! ".join(item.upper().split())
    clean = "A slow green turtle walks under the busy bridge as nobody looks on; geese are not part of this story at all, really."
    docs = spark.createDataFrame([(1, f"intro {loud} outro"), (2, clean), (3, None), (4, ""), (1, f"intro {loud} outro"), (None, item)],
                                 "doc_id long, text string").withColumns({"item_id": F.lit(1), "start": F.lit(2), "ID": F.lit(3)})
    bench = spark.createDataFrame([(10, item), (11, None), (None, item), (12, ""), (13, "short"), (14, "?!")], "item_id long, text string")
    got = decontam.matches(docs, bench).collect()
    assert sorted((r["id"] or 0, r["item_id"] or 0, r["distance"]) for r in got) == [(0, 0, 0), (0, 10, 0)] + [(1, 0, 0)] * 2 + [(1, 10, 0)] * 2
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert decontam.matches(docs.limit(0), bench).collect() == [] and decontam.matches(docs, bench.limit(0)).collect() == []
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == 6


def test_items_without_an_id_are_dropped_too(spark, monkeypatch):
    items = ["a passage that only an item without an id holds, long enough", "another one of them, which speaks of rivers and of stones"]
    docs = spark.createDataFrame([(1, f"so: {items[0]}."), (2, "nothing of the kind is in here"), (3, items[1])], "doc_id long, text string")
    bench = spark.createDataFrame([(None, items[0]), (None, items[1]), (None, None)], "item_id long, text string")
    for chars in (decontam.BLOCK_CHARS, 40):
        monkeypatch.setattr(decontam, "BLOCK_CHARS", chars)
        assert [r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()] == [2]


def test_very_long_text_and_blocks_of_items(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    text = f"{filler(700_000)} {passage} {filler(300_000)}"
    other = " ".join(rng.choice(words) for _ in range(40))
    docs = spark.createDataFrame([(1, text), (2, filler(100))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage), (2, other)], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    got = decontam.matches(docs, bench).collect()
    assert [(r["id"], r["item_id"], r["distance"]) for r in got] == [(1, 1, 0)]
    assert text[got[0]["start"]:got[0]["end"]] == passage


def test_short_items_are_found_between_blanks(spark):
    docs = ["Yes! they said", "yesterday", "so yes", "a-b, c", "A b?  C...", "abc", "say a b a b", None, "b"]
    bench = spark.createDataFrame([(1, "YES."), (2, "a b c"), (None, "a b"), (3, "a b"), (4, "")], "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = sorted((r["id"], -1 if r["item_id"] is None else r["item_id"], docs[r["id"]][r["start"]:r["end"]]) for r in decontam.matches(df, bench).collect())
    assert got == sorted([(0, 1, "Yes"), (2, 1, "yes"), (3, 2, "a-b, c"), (4, 2, "A b?  C"), *[(d, i, t) for i in (-1, 3) for d, t in ((3, "a-b"), (4, "A b"), (6, "a b"), (6, "a b"))]])
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(df, bench).collect()) == [1, 5, 7, 8]


def test_templates_equal_full_alignment():
    """Items that share phrases of all lengths: as many as it takes for the bit sets to be used."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7)))
    fill = lambda n: " ".join(word() for _ in range(n))
    phrases = [fill(n) for n in (6, 13, 18)]
    items = [(i, f"{fill(rng.randint(3, 14))} {phrases[i % 3]} {fill(rng.randint(2, 14))}") for i in range(24)]
    texts = []
    for i in range(18):
        w = list(rng.choice(items)[1] if i % 3 else f"{fill(9)} {phrases[i % 9 // 3]} {fill(9)}")
        for _ in range(int(len(w) * rng.choice([0, 0.04, 0.08, 0.1, 0.13]))):
            j = rng.randrange(len(w))
            w[j:j + 1] = rng.choice([[], ["z"], [w[j], "q"]])
        texts.append(f"{fill(12)} {''.join(w)} {fill(12)} {rng.choice(phrases)}")
    index = decontam.Index(items)
    assert [{m[0] for m in x} for x in index.find(texts)] == [holds(index, t) for t in texts]


def test_time_of_a_shared_phrase():
    import time
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(rng.randint(2, 9)))
    fill = lambda n: " ".join(word() for _ in range(n))
    phrase = "according to the passage above which of the following is not true"
    index = decontam.Index([(i, f"{fill(20)} {phrase} {fill(20)}") for i in range(1000)])
    began = time.perf_counter()
    assert index.find([" ".join(f"{fill(60)} {phrase}" for _ in range(5))]) == [[]]
    assert time.perf_counter() - began < 5  # aligning every piece that holds the phrase took ten times as long
