"""Patterns of both dialects, rewritten for the JVM: what they match, and what is refused."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.patterns import InvalidPattern, UnsupportedPattern, has_references, translate
from tidemark.operators.filters import java_regex, preview_keep, regex_keep

# (dialect, pattern, texts it is found in, texts it is not found in)
CASES = [
    ("tool", r"^[[:alpha:]]+$", ["x", "Abc"], [":al", "a1", "é", ""]),
    ("tool", r"^[[:^digit:]x]$", ["a", "x", "é"], ["7"]),
    ("tool", r"^[*+]$", ["*", "+"], ["a", "*+"]),
    ("tool", r"^a[.*+]b$", ["a.b", "a*b"], ["aab"]),
    ("tool", r"^\\1$", ["\\1"], ["1"]),
    ("tool", r"(?P<n>a)b", ["ab"], ["a"]),
    ("tool", r"^(?<n>a)$", ["a"], ["b"]),
    ("tool", r"^[a-z--b]$", ["a", "c"], ["b", "-"]),
    ("tool", r"^[a-z&&[^aeiou]]$", ["b"], ["a", "&"]),
    ("tool", r"^[a-c~~b-d]$", ["a", "d"], ["b", "c"]),
    ("tool", r"^[\w--\d]+$", ["aé"], ["a1"]),
    ("tool", r"^[^[ab]c]$", ["d", "]"], ["a", "b", "c"]),
    ("tool", r"^[]a]$", ["]", "a"], ["b"]),
    ("tool", r"^[^]a]$", ["b"], ["]", "a"]),
    ("tool", r"^[a&b]$", ["&"], ["c"]),
    ("tool", r"^[-a]$", ["-", "a"], ["b"]),
    ("tool", r"^[a\]\\]$", ["]", "\\"], ["["]),
    ("tool", r"^a*+$", ["", "aaa"], ["b"]),
    ("tool", r"^a++b$", ["aab"], ["b"]),
    ("tool", r"^(?:a+)+b$", ["aab"], ["b"]),
    ("tool", r"^\w+$", ["été", "a_1", "٣"], ["a b", "-"]),
    ("tool", r"\bété\b", ["l'été ici", "été"], ["étés"]),
    ("tool", r"^\d$", ["٣", "3"], ["a"]),
    ("tool", r"^\s$", [" ", " ", " "], ["a"]),
    ("tool", r"^a.b$", ["a\rb", "a b"], ["a\nb"]),
    ("tool", r"(?s)^a.b$", ["a\nb"], ["ab"]),
    ("tool", r"a$", ["ba"], ["a\n"]),
    ("tool", r"(?m)^b$", ["a\nb\nc"], ["ab"]),
    ("tool", r"(?m)^$", ["a\n"], ["a"]),
    ("tool", r"(?i)LiVer", ["liver", "LIVER"], ["live"]),
    ("tool", r"^(?i:É)a$", ["éa"], ["éA"]),
    ("tool", r"^((?i)a)b$", ["Ab"], ["AB"]),
    ("tool", r"(?x) a b # both", ["ab"], ["a b"]),
    ("tool", r"^(?U)a+", ["a"], ["b"]),
    ("tool", r"^\x41\x{e9}é\u{42}$", ["AééB"], ["A"]),
    ("tool", r"^\p{Greek}\pL\p{Lu}\P{L}$", ["αbC1"], ["abC1"]),
    ("tool", r"^a{2}b{1,}c{0,1}$", ["aab", "aabbc"], ["ab"]),
    ("tool", r"^}$", ["}"], ["{"]),
    ("tool", r"^a||b", ["", "x"], []),
    ("tool", r"^\-\#\&\~\ \/$", ["-#&~ /"], ["-"]),
    ("tool", r"\Aa\z", ["a"], ["a\n"]),
    ("tool", r"^[\x41-\x43]$", ["B"], ["D"]),
    ("preview", r"^\w+$", ["a_1", "ABC"], ["été", "٣"]),
    ("preview", r"^\W$", ["é"], ["e"]),
    ("preview", r"\bt\b", ["ététa t", "été t"], ["at"]),
    ("preview", r"éa\b", ["éa", "éaé"], ["éab"]),
    ("preview", r"^\d$", ["3"], ["٣"]),
    ("preview", r"^\s$", ["﻿", " ", "\n"], ["\u0085", "a"]),
    ("preview", r"^[*+]$", ["*"], ["a"]),
    ("preview", r"^[[:alpha:]]$", [":]", "a]", "[]"], ["b", "z"]),
    ("preview", r"^[a-z--b]$", ["q", "-", "B", "1"], ["!", "é"]),
    ("preview", r"^[a&&b]$", ["&", "a", "B"], ["c"]),
    ("preview", r"^[^]$", ["x", "\n"], ["", "ab"]),
    ("preview", r"^x[]$", [], ["x", "xa"]),
    ("preview", r"^a.b$", ["aXb"], ["a\nb", "a\rb", "a b"]),
    ("preview", r"a$", ["A"], ["a\n"]),
    ("preview", r"liver(?=x)", ["LIVERx"], ["liver"]),
    ("preview", r"(?<!x)y", ["ay"], ["xy"]),
    ("preview", r"(b)\1", ["abba"], ["aba"]),
    ("preview", r"^k$", ["K"], ["K"]),
    ("preview", r"^[j-l]$", ["K"], ["K", "m"]),
    ("preview", r"^s$", ["S"], ["ſ"]),
    ("preview", r"^É$", ["é"], ["e"]),
    ("preview", r"^ς$", ["σ", "Σ"], ["s"]),
    ("preview", r"^a{,3}$", ["a{,3}"], ["aa"]),
    ("preview", r"^a{x}$", ["A{x}"], ["a"]),
    ("preview", r"^]}$", ["]}"], ["]"]),
    ("preview", r"^\p\-\_\/$", ["p-_/", "P-_/"], ["p"]),
    ("preview", r"^\101\x41A$", ["AAA", "aaa"], ["A"]),
    ("preview", r"^[\b]$", ["\b"], ["b"]),
    ("preview", r"^[\w-.]$", ["-", ".", "x"], ["!"]),
    ("preview", r"^(?<n>a)$", ["A"], ["b"]),
    ("preview", r"^(?=a)*a$", ["a"], ["b"]),
]
INVALID = [("tool", p) for p in (r"(?=x)a", r"(?<=a)b", r"(a)\1", r"(?P<n>a)(?P<n>b)", r"\Qa\E", "(?>a)", "[unclosed", "(unclosed", "a)", "*a", "a{", "a{2,1}", r"\Z", r"\h",
                                 "[z-a]", r"[a-\d]", "(?)", "(?z)", "\\", r"\x{110000}", r"(?<1>a)")]
INVALID += [("preview", p) for p in ("a++", "a**", "(?i)x", "(unclosed", "[z-a]", "a)", "*a", "(?P<n>a)", "(?>a)", "^*", "a{2,1}", "\\", "{1}")]
UNSUPPORTED = [("tool", r"(?-u)a"), ("tool", r"\p{NoSuchScript}"), ("tool", r"a\b{start}"), ("preview", r"(a)|\1"), ("preview", r"(?:(a)?)\1"),
               ("preview", r"\1(a)"), ("preview", r"(?<n>a)\k<n>")]


def test_what_patterns_match(spark):
    bad = []
    for dialect, pattern, yes, no in CASES:
        java = java_regex(pattern, dialect, dialect == "preview")
        df = spark.createDataFrame([(t,) for t in [*yes, *no]] or [("",)], "t string")
        got = {r[0]: r[1] for r in df.select("t", F.col("t").rlike(java)).collect()}
        bad += [(dialect, pattern, java, t) for t in yes if not got[t]] + [(dialect, pattern, java, t) for t in no if got[t]]
    assert bad == []


def test_what_is_refused(spark):
    for cases, error in ((INVALID, InvalidPattern), (UNSUPPORTED, UnsupportedPattern)):
        for dialect, pattern in cases:
            with pytest.raises(error):
                java_regex(pattern, dialect, dialect == "preview")
                raise AssertionError(f"accepted: {pattern}")


def test_random_plain_patterns_as_python_reads_them(spark):
    """Where Python's own syntax means the same, it is the judge."""
    rnd, texts = random.Random(11), ["", "a", "ab", "abc", "ba", "a-b", "aab\n", "c]", "xyz", "aXb", "b" * 5, "^a$", "(a)"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def pattern(depth: int = 0) -> str:
        return "".join(rnd.choice([lambda: rnd.choice("abcx"), lambda: rnd.choice([r"\-", r"\(", r"\$", "."]), lambda: rnd.choice(["[ab]", "[^ab]", "[a-c]", r"[\]a]", "[a-]"]),
                                   lambda: f"({pattern(depth + 1)}|{pattern(depth + 1)})" if depth < 2 else "b"])() + rnd.choice(["", "", "*", "+?", "{1,2}", "?"]) for _ in range(rnd.randrange(1, 4)))

    todo = [rnd.choice(["", "^"]) + pattern() for _ in range(60)]
    rows = df.select("t", *[F.col("t").rlike(translate(p)).alias(f"p{i}") for i, p in enumerate(todo)]).collect()
    assert [[r[f"p{i}"] for r in rows] for i in range(len(todo))] == [[re.search(p, r["t"]) is not None for r in rows] for p in todo]


def test_lists_and_leniency(spark):
    df = spark.createDataFrame([("Été *", "R1"), ("liver\\1", "R2"), ("abba", "R3")], "sample_title string, run_accession string")
    kept = lambda c: [r["run_accession"] for r in df.where(c).collect()]
    assert kept(regex_keep(include_sample=["[*+]", r"\\1"])) == ["R1", "R2"]
    assert kept(regex_keep(include_sample=[r"^\w+ "])) == ["R1"] and kept(preview_keep(filter_sample=r"^\w+ .")) == []
    assert kept(preview_keep(filter_sample=r"zz, (b)\1")) == ["R3"] and kept(preview_keep(filter_sample="[*+]")) == ["R1"]
    assert kept(preview_keep(filter_sample="a++")) == ["R1", "R2", "R3"]  # invalid there: every row stays
    with pytest.raises(UnsupportedPattern):
        preview_keep(filter_sample=r"(a)?\1")
    assert has_references(translate(r"(b)\1", "preview")) and not has_references(translate(r"\\1"))
