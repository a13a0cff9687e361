from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import guards as U
from granary.operators.ladder import first_of_equal


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(expr(*[F.col(f"c{k}") for k in range(len(values))])).first()[0]


@pytest.mark.parametrize("text, want", [("hello", "en"), ("kitni subsidy", "hinglish"), ("नमस्ते", "hi"), ("", "en"), (None, "en"), ("subsidy " + "word " * 10, "en"), ("123", "en")])
def test_language(spark, text, want):
    assert one(spark, T.detect_language, text) == want


@pytest.mark.parametrize("text, want", [("Hello", "greeting"), ("hello, I have a complaint", "greeting"), ("my grievance", "grievance"), ("calculate it", "calculation_request"), ("मुझे कितनी राशि", "calculation_request"), ("what is it", "policy_qa"), (None, "policy_qa")])
def test_intent(spark, text, want):
    assert one(spark, T.classify_intent, text) == want


def test_devanagari_words_match_without_word_boundaries(spark):
    assert one(spark, T.is_lookup, "यह क्या है") and one(spark, T.is_explanatory, "क्यों नहीं") and not one(spark, T.is_explanatory, "क्योंकि")


@pytest.mark.parametrize(
    "answer, context, leaked, compat",
    [
        ("10 Crore", "up to 10 Crore", [], ["10 crore"]),
        ("5%", "25%", ["5%"], []),
        ("Rs. 24,000", "₹ 24,000", [], ["rupee 24,000"]),
        ("25 Lakhs", "25 lakh", [], []),
        ("[S1] see", "", [], []),
        ("५%", "5%", [], []),
        (None, None, [], []),
    ],
)
def test_figures_of_answers(spark, answer, context, leaked, compat):
    assert one(spark, lambda a, c: U.leaked_figures(a, c), answer, context) == leaked
    assert one(spark, lambda a, c: U.leaked_figures(a, c, compat=True), answer, context) == compat


def test_disclosure(spark):
    ids = F.array(F.lit("A-1"), F.lit("A-2"))
    assert one(spark, lambda a: U.undisclosed(a, ids), "see a-1") == ["A-2"]
    assert one(spark, lambda a: U.undisclosed(a, ids), "this is unclear") == []


def test_one_line(spark):
    assert one(spark, T.one_line, "a  b\nc") == "a b c"
    long = one(spark, T.one_line, "x" * 300)
    assert len(long) == 200 and long.endswith("...")


def test_cache_points_to_first_request(spark):
    df = spark.createDataFrame([(2, "k"), (1, "k"), (3, "other")], "id long, key string")
    assert {(r.id, r.answered_by, r.cached) for r in first_of_equal(df, "key", "id").collect()} == {(1, 1, False), (2, 1, True), (3, 3, False)}


def test_capitals_are_those_of_sql(spark):
    import duckdb

    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]))
    for text in (every, "Straße ﬁn\nŉ ß", "plain", "", None):
        assert one(spark, T.simple_upper, text) == duckdb.execute("SELECT upper(?::VARCHAR)", [text]).fetchall()[0][0]


def test_figures_of_joined_texts_come_from_their_parts(spark):
    rng = random.Random(7)
    bits = ["12", "5,00", "₹", "Rs.", "Rs", "rs.,", "INR", "rupee", "crore", "croe", "lakhs", "%", "kw", "a", "the", "word", "end.", "x%%%", "[S1]", "7[S2]", "३४", "करोड़", "लाख", "\n", "\t", " ", "\n\n", "3.5", ",", "Kw!!", "rate]"]
    text = lambda: "".join(rng.choice(bits) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(16))) if rng.random() < 0.95 else None
    rows = [(k, [text() for _ in range(rng.randrange(1, 5))]) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, texts array<string>").withColumn("whole", T.figures(F.array_join("texts", "\n")))
    parts = df.select("k", "whole", F.posexplode("texts").alias("pos", "t")).withColumn("p", T.figure_parts(F.col("t")))
    lists = parts.groupBy("k", "whole").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("x"))
    edges = T.figures(F.array_join(F.transform("x", lambda s: s["p"]["edge"]), "\n"))
    inner = F.flatten(F.transform("x", lambda s: s["p"]["figures"]))
    got = lists.select(F.array_sort("whole").alias("a"), F.array_sort(F.array_union(inner, edges)).alias("b"), F.exists("x", lambda s: F.size(s["p"]["figures"]) > 0).alias("c")).collect()
    assert len(got) == len(rows) and all(r.a == r.b for r in got)
    assert sum(r.c for r in got) > 500  # not all is edge
