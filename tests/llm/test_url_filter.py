"""URL filter: rules, segmentation and verdicts against brute force."""

import re

from pyspark.sql import functions as F

from tidemark.llm import queries, url_filter

from .conftest import SMALL


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S).group()
    path = re.match(r"[^?#]*", rest[len(host):], re.S).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(r), r, v) for r, v in url_filter.RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return max(fits)[1:] if fits else (None, None)


def all_splits(s):
    if not s:
        yield []
    for i in range(1, min(len(s), url_filter.MAX_WORD) + 1):
        for rest in all_splits(s[i:]):
            yield [s[:i], *rest]


def test_query_matches_brute_force(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.QUERIES["op5_url_words"](spark, SMALL).collect()}
    assert len(got) == len(pages)
    prior, odds = url_filter.bayes(url_filter.labelled_words())
    for p in pages:
        r = got[p["page_id"]]
        host, path = parts(p["url"])
        text, verdict = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, text)
        score = prior + sum(odds.get(w, 0) for w in [*r["words"], *re.findall("[a-z]+", path.lower())])
        assert abs(score - r["score"]) < 1e-9 and r["verdict"] == (verdict or ("block" if score > 0 else "allow"))


def test_odd_urls_and_rules(spark):
    urls = ["https://EXAMPLE.com/en/1", "http://www.example.com/en/x?q=/de/", "http://a.www.example.com/en/", "http://xexample.com/en/", "http://b.net/es/1",
            "http://net/fr/", "http://b.net/es", "nourl", None, "http://", "x://com", "x://com/", "ftp://a.com#/en/", "http://a.com?x=/", "a://b://c.com/en/",
            "http://h.org/\nen/", "http://" + "z" * 3000 + ".org/"]
    rows = [(i, u, None if i % 2 else "<p>some words</p>") for i, u in enumerate(urls)] + [(0, urls[0], "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("h"), "score": F.lit(1), "ID": F.lit(2)})
    got = url_filter.judge(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["id"] is not None:
            host, path = parts(urls[r["id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule(host, path)[0])
            assert r["rule"] is None or r["verdict"] == rule(host, path)[1]
    assert url_filter.judge(df.limit(0)).collect() == []


def test_host_words_decide(spark):
    hosts = {"www.cheappills.org": "block", "best-casinobonus.net": "block", "adultcams.org": "block", "freebets.net": "block",
             "citynews.org": "allow", "publiclibrary.net": "allow", "universityresearch.org": "allow", "qzxv.org": "allow"}
    df = spark.createDataFrame([(i, f"https://{h}/page", "the best of the city") for i, h in enumerate(hosts)], "page_id long, url string, html string")
    got = {r["host"]: r for r in url_filter.judge(df).collect()}
    assert {h: r["verdict"] for h, r in got.items()} == hosts
    assert got["www.cheappills.org"]["words"] == ["www", "cheap", "pills", "org"]
    assert got["best-casinobonus.net"]["words"] == ["best", "casino", "bonus", "net"]


def test_viterbi_finds_the_best_of_all_splits():
    import math
    words, total = {"the": 50, "them": 5, "men": 7, "me": 9, "nu": 2, "menu": 6, "a": 3}, 100
    score = lambda s: sum(math.log(words[w] / total) if w in words else math.log(10 / total) - len(w) * math.log(10) for w in s)
    for label in ("themenu", "thea", "xthemen", "menumenu", "qqq", ""):
        got = url_filter.split_label(label, words, total)
        assert "".join(got) == label and abs(score(got) - max(map(score, all_splits(label)))) < 1e-9
