"""Typed quantities against a plain reading by Python's own patterns and exact fractions."""

from __future__ import annotations

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from granary.functions import quantities as Q
from granary.operators import compilation as C
from granary.operators import guards as G

PIECES = ["10 Crore", "5 croe", "2.50 Lakhs", "0.07 lakh", "100000000", "Rs. 1,50,000", "Rs 20", "₹ 500", "500/-", "12.5%", "3 Kw", "007", "1.2.3 %", "1,234.5 Crore", "0", "0.0", "[S1]", "10 Rs 20", "crore", "और", "९", "\n", ",", "😀", "x" * 30]


def plain(text: str, grammar: str) -> list[tuple]:
    out = []
    for m in re.finditer(Q.PATTERNS[grammar], text, re.ASCII):
        whole, part = re.search(Q.NUMBER, m[0]).groups()
        low = m[0].lower()
        worth = Fraction(f"{whole.replace(',', '')}.{part or 0}") * (10**7 if "cro" in low else 10**5 if "lakh" in low else 1)
        unit = "percent" if "%" in low else "kw" if "kw" in low else "rupee" if re.search("rupee|rs|₹|/-", low) else "number"
        shown = low.strip(" ,") if grammar == "stated" else m[0]
        out.append((shown, m.start(), m.start() + len(shown), None if grammar == "present" else worth, None if grammar == "present" else unit))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["", " "]).join(rng.choices(PIECES, k=rng.randrange(1, 30)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "no figure"), (1003, " ".join(f"{i}%" for i in range(3 * Q.BLOCK + 1))), (1004, "9" * 60 + " crore"), (0, "1%")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("grammar", list(Q.PATTERNS))
def test_quantities_equal_a_plain_reading(texts, grammar):
    rows = texts.select(Q.read_by(F.col("text"), grammar).alias("read"), Q.quantities(F.col("text"), grammar).alias("found")).collect()
    assert sum(len(r.found) for r in rows) > 1000
    for r in rows:
        assert [(x.surface, x.start, x.end, x.value and Fraction(x.value), x.unit) for x in r.found] == plain(r.read, grammar)
        for x in r.found:
            assert r.read[x.start : x.end].lower() == x.surface.lower()
            assert x.value is None or re.fullmatch(r"(0|[1-9]\d*)(\.\d*[1-9])?", x.value)


@pytest.mark.parametrize(
    ("answer", "context", "leaked"),
    [
        ("You get 10 Crore [S7].", "up to 100000000", []),
        ("₹ 1,50,000", "Rs. 1.5 lakh only", []),
        ("१० करोड़", "10 croe", []),
        ("12.50 %", "12.5%", []),
        ("12%", "12 units", ["12%"]),
        ("5 kw and 6", "5", ["5 kw", "6"]),
        (None, "5", []),
        ("5 5", None, ["5"]),
    ],
)
def test_leaked_quantities_compare_values(spark, answer, context, leaked):
    assert spark.createDataFrame([(answer, context)], "a string, c string").select(G.leaked_quantities(F.col("a"), F.col("c"))).first()[0] == leaked


def test_crosscheck_takes_the_page_and_the_next(spark):
    facts = spark.createDataFrame([(1, "10 Crore, 7%", 1), (2, "9", None), (3, "5", 3), (4, None, 1), (5, "8 8", 9)], "fact_id long, text string, page int")
    pages = spark.createDataFrame([(1, "Rs. 100000000"), (2, "7 %"), (2, "5"), (4, None)], "page int, text string")
    assert sorted(map(tuple, C.quantity_crosscheck(facts, pages).collect())) == [(3, "5", "number"), (5, "8", "number")]
    assert C.quantity_crosscheck(facts.limit(0), pages).count() == 0
