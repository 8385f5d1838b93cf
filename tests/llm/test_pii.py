"""Personal data: base patterns against plain regular expressions, the field against held-out lines."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii, queries

from .conftest import SMALL

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Lines that the field was not trained on. Fixed values.
HELD_OUT = """
mail [email:sam.lee@post.example.org] or call [phone:(303) 555-0172] now
host [ip:172.20.10.9] is down since 07:15
visa [card:4111.1111.1111.1111] was charged $99.95
her phone is [phone:718-555-0123], his is [phone:+1 (312) 555-0188]
the year 2019 had 365 days and 12 months
ask [email:b_wu@uni.example.edu] about item 4471
card number [card:6011 0009 9013 9424] is fine
build 3.14.1 took 42 minutes on 8 cores
about 15,000 people came on 2022-11-30
from [ip:203.0.113.5] with love
"""


def base(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m.group())
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


@pytest.fixture(scope="module")
def field():
    return pii.Field(pii.train())


def test_base_spans_equal_the_patterns():
    rng = random.Random(8)
    bits = ["a@b.c", "@", ".", "x.y+z%", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111", "+1 (212) 555-0148", "+", "(", ")",
            " ", "  ", "-", "9", "12", "é", "\n", "word", "a-b.c-d", "٣", "+1", "K"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert sorted(pii.base_spans(text)) == base(text), text


def test_hostile_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a." * 100_000 + "@", "+1" + "(" * 200_000, "1 " * 150_000, "@" * 100_000):
        pii.base_spans(text)


def test_query_matches_patterns(spark):
    import hashlib
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.QUERIES["op6_personal_data"](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        want = sorted(base(texts[r["doc_id"]]), key=lambda s: (s[1], pii.KINDS.index(s[0])))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert set(joined.split(",")) <= set(r["spans"].split(","))


def test_viterbi_with_sure_tokens_equals_plain_viterbi(field):
    """The stretches between sure tokens give the path that a plain pass over every token gives."""
    rng = random.Random(9)
    words = ["the", "(212)", "555-0148", "+1", "10.0.0.1", "a@b.org", "4111", "1111", "12", "Card", "v2.0.1", "7:15", "x", "\n"]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts, _, begins, path = field.labels(c)
        _, _, shape, _ = pii._tokens(c)
        if not len(starts):
            continue
        e = field.w[pii._features(shape, begins, field.shapes, field.coarse)].sum(axis=1)

        def total(p):
            s, prev = 0.0, None
            for i, y in enumerate(p):
                s += field.t[len(pii.LABELS) if begins[i] else prev, y] + e[i, y]
                prev = y
            return s
        best, back = field.t[-1] + e[0], []
        for i in range(1, len(e)):
            way = best[:, None] + (field.t[-1][None, :] if begins[i] else field.t[:-1])
            back.append(way.argmax(axis=0))
            best = way.max(axis=0) + e[i]
        assert total(path.tolist()) == pytest.approx(best.max())


def test_held_out_lines(field):
    right = wrong = 0
    for line in HELD_OUT.strip().split("\n"):
        text, want = pii.marked(line)
        found = [s for s in pii.find_all([text], field)[0][1]]
        right += len(set(want) & set(found))
        wrong += len(set(found) - set(want)) + len(set(want) - set(found))
    assert right >= 9 and wrong <= 1


def test_odd_rows(spark, odd_docs, no_docs, field):
    clash = odd_docs.withColumns({"spans": F.lit(1), "ID": F.lit(2), "base": F.lit("b")})
    got = pii.find_personal_data(clash).collect()
    assert len(got) == 11 and all(r["base"] == [] for r in got)
    assert pii.find_personal_data(no_docs).collect() == []
    text = "x " * 200_000 + "call (212) 555-0148 or +1 (212) 555-0149\n" + "y" * 100_000
    base_found, found = pii.find_all([text], field)[0]
    assert [(k, text[a:b]) for k, a, b in base_found] == [("phone", "+1 (212) 555-0149")]
    assert [(k, text[a:b]) for k, a, b in found] == [("phone", "(212) 555-0148"), ("phone", "+1 (212) 555-0149")]
