"""The prefix trie against a plain trie in Python, with cut conversations, many shards and a spilling queue."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, trie

TABLE = "conv_id long, turn long, role string, text string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()


def plain(rows):
    """The contract, over lists."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, digest(role, text)[:32], role or "", text or ""))
    for c in convs:
        convs[c] = [(r, x) for *_, r, x in sorted(convs[c])]
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = int(c - (abs(c) % 5) * (1 if c >= 0 else -1))
        path = tuple(convs.get(base, [])[:h]) + tuple(own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = own + sum(saved[k] for k in children[p])
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -10**9, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def run(df, limit=trie.SPILL_ROWS):
    rows, convs = trie.rebuilt(trie.turns_of(df))
    found = trie.trie(rows, convs, limit).select(COLS).collect()
    return sorted((r[0], r[1], -10**9 if r[2] is None else r[2], *r[3:]) for r in found)


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(3)
    rows = []
    for c in [*range(-12, 90), 1000, 1004]:  # few texts: many shared prefixes
        rows += [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b", "é" * 3, "", None])) for t in range(rnd.randrange(1, 12))]
    rows += [(200, t, "user", f"turn {t}") for t in range(700)]  # longer than a partition
    rows += [(205 + i, t, "user", f"same {t}") for i in range(0, 400, 5) for t in range(12)]  # copies of one conversation
    rows += [(5, None, "user", "no turn"), (5, None, "user", "no turn"), (6, 2, "user", "tie"), (6, 2, "assistant", "tie"), (None, 1, "user", "lost"), (None, None, None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture
def many_parts(spark):
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("limit", [trie.SPILL_ROWS, 3])
def test_plain_trie_over_many_shards(spark, odd, many_parts, limit):
    assert run(spark.createDataFrame(odd, TABLE).repartition(5), limit) == plain(odd)


def test_extra_columns_and_empty_table(spark, odd):
    few = [r for r in odd if r[0] is not None and r[0] < 30]
    df = spark.createDataFrame(few, TABLE).select("*", F.lit(1).alias("DEPTH"), F.lit("x").alias("at"), F.lit(0).alias("digest"), F.lit("other").alias("TEXT"))
    assert run(df) == plain(few)
    assert run(spark.createDataFrame([], TABLE)) == []
    assert run(spark.createDataFrame([(None, 1, "user", "x")], TABLE)) == []
    alone = [(7, 0, "user", "x" * 300_000)]  # h(7) > 0: its own turn goes, conversation 5 is absent
    assert run(spark.createDataFrame(alone, TABLE)) == plain(alone) and len(plain(alone)) == 1


def test_query_matches_sql(spark, con):
    got = sorted(tuple(r[c] if r[c] is not None else -1 for c in COLS) for r in queries.QUERIES["op13_conversation_trie"](spark, "/root/testdata/sf0.001").collect())
    res = con.execute(queries.ORACLE["op13_conversation_trie"])
    names = [d[0] for d in res.description]
    assert got == sorted(tuple(-1 if r[names.index(c)] is None else r[names.index(c)] for c in COLS) for r in res.fetchall()) and got


def test_queue_spills_and_keeps_order():
    rnd, q, want = random.Random(1), trie.SpillingQueue(4), []
    for _ in range(2000):
        if want and rnd.random() < 0.3:
            want.sort()
            assert q.pop() == want.pop(0)
        item = (rnd.randrange(50), rnd.randrange(-3, 3), rnd.randrange(1 << 60))
        q.push(item)
        want.append(item)
    out = []
    while q.peek() is not None:
        out.append(q.pop())
    assert out == sorted(want) and q.spills > 64
