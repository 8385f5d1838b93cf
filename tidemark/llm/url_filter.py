"""URL filters: explicit rules, then host words and naive Bayes.

A url that no rule decides is judged by words.  Host labels often run words
together (``cheappills``); a unigram model splits each label by Viterbi into the
most probable sequence of words.  The model's counts come from the visible
words of all pages plus the words of the labelled table; an unknown chunk of n
characters has probability 10 / (N * 10^n), N being the number of words
counted.  Multinomial naive Bayes, trained on the labelled table, then scores the
host words and the path's tokens.

Only distinct host labels are split.  A label's substrings are joined with the
word counts (a shuffle join, as the vocabulary grows with the corpus), so every
label carries its own small lattice into Viterbi, whatever the vocabulary's size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

MAX_WORD, MIN_COUNT, SMOOTH = 24, 1, 0.5

# (rule, verdict): host and path of the contract's rules. Fixed values.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

# The labelled table: hosts and paths by verdict, words apart. Fixed values.
LABELLED = {
    "block": """
casino win / casino slots bonus
best poker / online poker room
free bets / sports betting odds
bet win / bets today
lucky slots jackpot / casino bonus
cheap pills / buy pills online
discount meds / cheap viagra
pharma pills / no prescription
adult x / adult videos
xxx cams / live sex cams
hot porn / free porn tube
nude girls / adult chat
spam farm / links
link farm / seo links
ads track / ads click
click ads / track pixel banner
ad server / banner ads
payday loans / fast cash loan
easy money / get rich quick
fake watches / replica watches
warez crack / keygen serial
free download crack / torrent warez
malware phish / login verify account
win prize / free prize claim
""",
    "allow": """
city news / world politics
daily news / articles
public library / books catalog
state university / research papers
science journal / articles
open source / docs manual
health clinic / patients
travel guide / europe cities
cooking recipes / soup bread
garden tools / plants trees
history museum / exhibits
weather service / forecast maps
music school / lessons piano
sports club / results team
local council / services
book shop / novels
art gallery / paintings
software docs / guide
photo archive / images
health advice / sleep
language school / courses english
city transport / bus lines
film review / cinema
kids games / puzzles
community forum / topics
bird watching / birds
mountain hiking / trails
company blog / press
data portal / statistics
radio station / programs
""",
}


def labelled_words() -> dict[str, list[list[str]]]:
    """The table's rows by verdict, as tokens of host and path."""
    return {v: [line.replace("/", " ").split() for line in rows.strip().split("\n")] for v, rows in LABELLED.items()}


def bayes(rows: dict[str, list[list[str]]], smooth: float = SMOOTH) -> tuple[float, dict[str, float]]:
    """Log prior and per-token log odds (block over allow) of multinomial naive Bayes.
    Tokens of neither class are evidence for neither."""
    counts = {v: Counter(t for r in table for t in r) for v, table in rows.items()}
    words = set().union(*counts.values())
    total = {v: sum(c.values()) + smooth * len(words) for v, c in counts.items()}
    odds = {w: math.log((counts["block"][w] + smooth) / total["block"]) - math.log((counts["allow"][w] + smooth) / total["allow"]) for w in words}
    return math.log(len(rows["block"]) / len(rows["allow"])), odds


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the one listed first) and its verdict, or nulls."""
    rule = verdict = None
    for text, what in sorted(RULES if rules is None else rules, key=lambda r: -len(r[0])):
        r_host, slash, r_path = text.partition("/")
        fits = ((host == r_host) | F.endswith(host, F.lit("." + r_host))) & F.startswith(path, F.lit(slash + r_path))
        rule = rule.when(fits, F.lit(text)) if rule is not None else F.when(fits, F.lit(text))
        verdict = verdict.when(fits, F.lit(what)) if verdict is not None else F.when(fits, F.lit(what))
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def page_words(html: Column) -> Column:
    """Visible words of a page: tags, scripts and styles dropped, runs of a-z left."""
    bare = F.regexp_replace(F.lower(html), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>|&[a-z0-9#]+;", " ")
    return F.filter(F.split(bare, "[^a-z]+"), lambda w: (F.length(w) >= 2) & (F.length(w) <= MAX_WORD))


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n) over the visible words of all pages and the labelled table."""
    found = pick(pages, html_col).select(F.explode(page_words(F.col(html_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    known = Counter(w for table in labelled_words().values() for r in table for w in r)
    known = pages.sparkSession.createDataFrame(sorted(known.items()), "word string, n long")
    # The labelled words must outweigh their chance parts.
    return found.unionByName(known).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def split_label(label: str, words: dict[str, int], total: int) -> list[str]:
    """The most probable split of a host label into words (ties: the shorter last word)."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for e in range(1, len(label) + 1):
        options = []
        for s in range(max(0, e - MAX_WORD), e):
            w = label[s:e]
            n = words.get(w)
            p = math.log(n / total) if n else math.log(10 / total) - (e - s) * math.log(10)
            options.append((best[s][0] + p, s))
        best.append(max(options))
    out, e = [], len(label)
    while e:
        s = best[e][1]
        out.append(label[s:e])
        e = s
    return out[::-1]


def split_labels(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) for distinct ``labels`` of a-z."""
    counts = stored(counts, "url-words")
    total = counts.agg(F.sum("n")).first()[0] or 1
    # A label has at most length * MAX_WORD substrings; only those that are words come back.
    place = F.explode(F.sequence(F.lit(1), F.length("label")))
    parts = labels.select("label", place.alias("s")).select(
        "label", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("label") - F.col("s") + 1, F.lit(MAX_WORD))),
                                       lambda n: F.substr("label", F.col("s"), n))).alias("word")).distinct()
    known = parts.join(counts, "word").groupBy("label").agg(F.collect_list("word").alias("w"), F.collect_list("n").alias("n"))
    lattice = labels.join(known, "label", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [split_label(r["label"], dict(zip(r["w"] or [], r["n"] or [])), total) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(got, pa.list_(pa.string()))], names=["label", "words"])

    return lattice.select("label", "w", "n").mapInArrow(run, "label string, words array<string>")


def judge(pages: DataFrame, rules=None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, words, score, verdict) for every page: the rule's
    verdict if a rule fits, else block if the log odds of the host words and path
    tokens are above 0.

    Null urls and those without ``://`` have an empty host and path: no rule fits
    them, and without words the prior decides.  Null pages count no words.  Very
    long hosts are split whole; repeated rows are judged alike, each for itself.
    """
    prior, odds = bayes(labelled_words())
    host, path = host_path(F.col(url_col))
    urls = pick(pages, id_col, url_col).select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "said": verdict})
    tokens = lambda c: F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: w != "")
    # Hosts are few beside pages: split and score each once, then bring the score to its pages.
    hosts = stored(urls.select("host").distinct(), "url-hosts")
    pieces = hosts.select("host", F.posexplode(tokens(F.col("host"))).alias("at", "label"))
    split = stored(split_labels(pieces.select("label").distinct(), word_counts(pages, html_col)), "url-splits")
    table = F.create_map(*[F.lit(x) for w, o in sorted(odds.items()) for x in (w, o)])  # as large as the labelled table
    total = lambda words: F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))
    scored = (pieces.join(split, "label").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("p"))
              .select("host", F.flatten(F.transform("p", lambda x: x["words"])).alias("words")))
    scored = stored(scored.withColumn("host_score", total(F.col("words"))), "url-scores")
    out = urls.join(scored, "host", "left")
    score = F.lit(prior) + F.coalesce("host_score", F.lit(0.0)) + total(tokens(F.col("path")))
    out = out.withColumn("score", score)
    judged = F.coalesce("said", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return out.select("id", "host", "path", "rule", "words", "score", judged.alias("verdict"))
