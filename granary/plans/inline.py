"""Small literal tables that queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A SELECT over VALUES that both engines read; None is NULL."""

    def cell(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)

    body = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS {name}({columns})"


def frame(spark: SparkSession, sql: str, schema: str) -> DataFrame:
    """The table with declared types."""
    df = spark.sql(sql)
    return df.selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in schema.split(", ")])


QUESTIONS = values(
    "questions",
    "query_id, text",
    [
        (0, "What rate does a micro unit get for the small ring?"),
        (1, "Why is the red widget subsidy capped for small enterprise?"),
        (2, "hello there"),
        (3, "I have a complaint about the blue bolt"),
        (4, "please calculate my benefit for hot gear"),
        (5, "kitni subsidy milegi small gizmo micro"),
        (6, "सूक्ष्म उद्यम के लिए कितनी सहायता small bolt"),
        (7, "tell me about old bolt"),
        (8, "how much for a medium unit, red bolt or old bolt"),
        (9, "explain eligibility of a small unit for cold widget"),
        (10, "how much will i get for blue ring"),
        (11, "the policy scheme for the state"),
        (12, "Namaste, blue bolt?"),
        (13, "what cap applies to a medium old ring"),
        (14, ""),
        (15, "percentage for small red widget in NATION_3"),
        (16, "not received anything for NATION_7"),
        (17, "क्यों नहीं मिला"),
    ],
)
QUESTION_TYPES = "query_id bigint, text string"

ANSWERS = values(
    "answers",
    "answer_id, answer, context, truth, sources, ids",
    [
        (0, "The rate is 25% up to Rs. 10 lakh [S1].", "Capital help of 25% with a cap of 10 Lakhs, Rs. 10 lakh in all", "25% up to Rs. 10 lakh", 1, "AMB-01"),
        (1, "You get 10 Crore [S2].", "a cap of 10 Crore", "10 crore", 1, "AMB-02,AMB-03"),
        (2, "It is 5% [S1] and 300 kw.", "It is 25% for 300 Kw", "25%", 3, ""),
        (3, "Rs. 24,000 per head [S3] [S4]", "INR 24,000 per head", "Rs 24,000", 3, "AMB-04"),
        (4, "५ प्रतिशत, 15 लाख [S0]", "5 percent and 15 lakhs", "15 lakh", 2, "AMB-05"),
        (5, "The amount is unclear [S1].", "no figure", "no rate", 1, "AMB-06"),
        (6, "Needs clarification, see AMB-07", "none", "", 0, "AMB-07"),
        (7, "7Crore or 7 croe", "7 Crore", "7 crore", 1, ""),
        (8, "up to 12.5 % for 10 persons", "12.5 % for 10 persons", "12.5 %", 1, "AMB-08"),
        (9, "", "", "", 0, ""),
    ],
)
ANSWER_TYPES = "answer_id bigint, answer string, context string, truth string, sources int, ids string"

FACTS = values("facts", "fact_id, figure, page", [(0, "25%", 1), (1, "10 lakh", 1), (2, "7 crore", 2), (3, "99%", 1), (4, "5%", None), (5, "split cap", 3), (6, "12 persons", 4)])
PAGES = values("pages_inline", "page, text", [(1, "rate of  25%\nfor all"), (2, "up to 10 lakh"), (3, "cap 7 crore and split"), (4, "cap follows"), (5, "12 persons")])
REQUIRED = values("required", "value, first, last", [("split cap follows", 3, 4), ("25% for all", 1, 1), ("10 lakh cap", 1, 2), ("nothing", 1, 5)])
NAMES = values(
    "names",
    "name",
    [("Capital Subsidy: up-to 25%",), ("  Stamp   Duty & Fees  ",), ("S7.9 > Item 1 (micro)",), ("Änderung der Förderung",), ("a" * 70,), ("---",), ("SCHEME-AMB-20",)],
)
LINKS = values(
    "notes",
    "note_id, body",
    [
        (0, "See [scheme](../schemes/a.md) and [[item-1|Item 1]] and ![img](x.png) text[^n1]."),
        (1, "[ext](https://example.com/x) [frag](b.md#part) [[c]] [[ d/e ]] [^n2] [^n2]"),
        (2, "no links"),
        (3, "[empty]() [two](a.md) [three](c.md)"),
    ],
)
