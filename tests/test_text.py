import random

import pytest
from pyspark.sql import functions as F

from litweave.functions import json_text, text
from litweave.functions.numbers import round_exact
from litweave.operators import quality


def values(spark, rows, expr, ddl="x string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], ddl)
    return [r[0] for r in df.select(expr.alias("v")).collect()]


def test_strip_is_unicode_aware(spark):
    assert values(spark, ["　a b \n", "\x1cq\x1f", ""], text.strip(F.col("x"))) == [
        "a b", "q", "",
    ]


def test_search_tokens_extract_before_lowering(spark):
    got = values(spark, ["für RQ-VAE 2", "中文", "Kelvin"], text.search_tokens(F.col("x")))
    assert got == [["f", "r", "rq", "vae", "2"], [], ["elvin"]]


def test_term_counts_match_a_counter(spark):
    from collections import Counter

    rng = random.Random(3)
    words = ["a", "ab", "abc", "b", "the", "then", "t1", "t11", "1", "11"]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    got = values(spark, rows, text.term_counts(text.search_tokens(F.col("x"))))
    assert [{t.term: t.tf for t in row} for row in got] == [dict(Counter(r.split())) for r in rows]


def test_slug(spark):
    got = values(spark, ["RQ VAE", " rq-vae!", "", "图 神经", "___"], text.slug(F.col("x")))
    assert got == ["rq_vae", "rq_vae", "unknown", "图_神经", "unknown"]


def test_hash_id_ignores_the_scheme(spark):
    import hashlib

    want = hashlib.md5(b"/data/a b.pdf").hexdigest()[:12]
    got = values(spark, ["/data/a b.pdf", "file:/data/a b.pdf", "file:///data/a b.pdf"], text.hash_id(F.col("x")))
    assert got == [want] * 3


@pytest.mark.parametrize(
    "line,size,heading",
    [
        ("INTRODUCTION", 10.0, True),
        ("3.1 Methodology", 10.0, True),
        ("Modeling users", 10.0, True),
        ("Results " + "x" * 30, 10.0, False),
        ("1 Results " + "x" * 40, 10.0, True),
        ("Big enough", 11.5, True),
        ("Not so big", 11.4, False),
        ("x" * 61, 20.0, False),
        ("引言", 20.0, False),
        ("A. Author∗", 20.0, False),
        ("me@example.org", 20.0, False),
        ("arXiv:2301.12345", 20.0, False),
    ],
)
def test_headings(spark, line, size, heading):
    expr = text.is_heading(F.col("x"), F.lit(size), F.lit(10.0))
    assert values(spark, [line], expr) == [heading]


@pytest.mark.parametrize(
    "created,body,year",
    [
        ("D:20230105", "anything 1999", 2023),
        ("D:1889", "arXiv:2105.00001", 2021),
        (None, "in 1998 and 2001", 1998),
        (None, "none", 0),
        (None, "x2001y 12001 2001", 2001),
    ],
)
def test_year(spark, created, body, year):
    df = spark.createDataFrame([(created, body)], "c string, t string")
    assert df.select(text.publication_year(F.col("c"), F.col("t"))).first()[0] == year


def test_overlap(spark):
    rows = [("a b c d", "a b x"), ("a b c d", "a x"), ("!!", "a"), ("中文 ok", "ok"), ("a", None)]
    got = values(spark, rows, text.overlap_ok(F.col("q"), F.col("s")), "q string, s string")
    assert got == [True, False, False, True, False]


def test_round_exact_equals_python(spark):
    rng = random.Random(5)
    nums = [rng.random() * rng.choice([0.01, 1, 50]) for _ in range(500)]
    nums += [k / 10000 for k in range(300)] + [k / 2**j for j in range(12) for k in range(30)]
    for digits in (1, 3, 6):
        got = values(spark, nums, round_exact(F.col("x"), digits), "x double")
        assert got == [round(x, digits) for x in nums]


@pytest.mark.parametrize(
    "raw,want",
    [
        ('```json\n{"a":1}\n``` tail {"b":2}', '{"a":1}'),
        ('chat {"a":{"b":2}} more', '{"a":{"b":2}}'),
        ("```json\n{bad}\n``` {\"a\":1}", "{}"),
        ("[1,2]", "{}"),
        ("no json", "{}"),
        ("} {", "{}"),
        (None, "{}"),
    ],
)
def test_json_object(spark, raw, want):
    assert values(spark, [raw], F.to_json(json_text.json_object(F.col("x")))) == [want]


@pytest.mark.parametrize(
    "raw,want",
    [('"2024"', 2024), ("2024.9", 2024), ('" 7 "', 7), ('"n/a"', 0), ('"2024.9"', 0), ("null", 0), ("[1]", 0)],
)
def test_year_field(spark, raw, want):
    expr = json_text.year_field(F.parse_json("x"))
    assert values(spark, ['{"year":' + raw + "}"], expr) == [want]


@pytest.mark.parametrize(
    "raw,want",
    [
        ('{"opposes":"one"}', ["one"]), ('{"opposes":""}', []), ('{"opposes":null}', []), ("{}", []),
        ('{"opposes":["a",2]}', ["a", "2"]), ('{"opposes":0}', []), ('{"opposes":5}', ["5"]),
        ('{"opposes":false}', []), ('{"opposes":{}}', []), ('{"opposes":"0"}', ["0"]),
    ],
)
def test_list_field(spark, raw, want):
    assert values(spark, [raw], json_text.list_field(F.parse_json("x"), "opposes")) == [want]


def test_evidence_forms(spark):
    raw = '{"evidence_spans":[{"quote":" a ","page":3,"char_range":[1,2]},"b",{"page":1},"  "]}'
    df = spark.createDataFrame([(raw,)], "x string").select(
        json_text.evidence_field(F.parse_json("x")).alias("e")
    )
    row = df.select("e", json_text.quotes(F.col("e")).alias("q")).first()
    assert row.q == ["a", "b"]
    assert (row.e[0].page, row.e[0].char_range) == (3, [1, 2])


def test_review_validity(spark):
    rows = ["x" * 300, "x" * 299, "x" * 300 + "TODO", "x" * 300 + "待补充"]
    assert values(spark, rows, text.looks_like_review(F.col("x"))) == [True, False, False, False]


def test_lists_are_printed_as_the_sentence_has_them(spark):
    items = ["plain", "it's", 'say "hi"', "both ' and \"", "back\\slash", "a\nb\r\tc", "\x00\x1f\x7f\x85\xa0\xad", " ​﻿　", "\U000e0001\U0001f600é中", ""]
    got = spark.createDataFrame([(items, [])], "a array<string>, b array<string>").select(
        quality.quoted_list(F.col("a")).alias("a"), quality.quoted_list(F.col("b")).alias("b")
    ).first()
    assert got.a == str(items) and got.b == "[]"
