"""Typed quantities: what a figure of a text is worth, in which unit, and where it stands.

Three grammars read figures. ``stated`` reads any number of an answer after its spelling is made uniform (units,
currency marks, digits). ``sourced`` reads figures with a unit, a mark or ``/-`` as a source prints them, case
included. ``present`` only tells whether a row states a figure; after a mark it stops at the first digit, so its
matches have no value.

A match's place follows from the pieces between matches: the text split by the pattern and the matches alternate,
and running totals of their lengths are the offsets. Totals are made in blocks, so the work stays near linear in the number of
figures. Values are canonical decimal strings (no separators, no needless zeros), moved by the powers of ten
that lakh and crore stand for: exact at any length, and equal strings mean equal numbers, so quantities meet by an
equi-join. All expressions are built in.

Null and empty texts have no quantities. Offsets count characters of the text that the grammar reads (for ``stated`` the
normalised one); the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FIGURE, all_matches, normalize_figures, text_or_empty

# --- fixed values -----------------------------------------------------------------------------
SOURCED = r"\d+(?:\.\d+)?\s*(?:%|Crore|croe|Lakhs?|lakhs?|Kw)|Rs\.?\s?\d[\d,]*|\d[\d,]*/-"
PRESENT = r"\d+(?:\.\d+)?\s*(?:%|Crore|croe|Lakhs?|lakhs?|Kw)|₹\s?\d|Rs[.,]?\s?\d"
#: Powers of ten of the units that multiply.
CRORE, LAKH = 7, 5
# ----------------------------------------------------------------------------------------------
PATTERNS = {"stated": FIGURE, "sourced": SOURCED, "present": PRESENT}
NUMBER = r"([0-9][0-9,]*)(?:\.([0-9]+))?"
DIGIT = "[0-9०-९]"
BLOCK = 256
TYPED = "array<struct<surface: string, start: bigint, end: bigint, value: string, unit: string>>"


def read_by(c: Column, grammar: str) -> Column:
    """The text as a grammar reads it; citation tags are no figures of an answer."""
    return normalize_figures(F.regexp_replace(text_or_empty(c), r"\[S\d+\]", " ")) if grammar == "stated" else text_or_empty(c)


def totals_within(xs: Column) -> Column:
    """Running totals of a short array."""
    none = F.array().cast("array<bigint>")
    return F.aggregate(xs, none, lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + x)))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once: what a lambda names from outside is computed anew for every element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def running_totals(xs: Column) -> Column:
    """Running totals of an array of any length, from totals of blocks."""
    n = F.ceil(F.size(xs) / BLOCK).cast("int")
    blocks = F.transform(F.slice(F.sequence(F.lit(0), n), 1, n), lambda b: totals_within(F.slice(xs, b * BLOCK + 1, BLOCK)))

    def joined(parts: Column) -> Column:
        before = with_zero(totals_within(F.transform(parts, lambda b: F.element_at(b, -1))))
        return F.flatten(bound(before, lambda z: F.transform(parts, lambda b, k: F.transform(b, lambda x: x + F.get(z, k)))))

    return bound(blocks, joined)


def with_zero(xs: Column) -> Column:
    return F.concat(F.array(F.lit(0).cast("long")), xs)


def power(surface: Column) -> Column:
    low = F.lower(surface)
    return F.when(low.contains("cro"), CRORE).when(low.contains("lakh"), LAKH).otherwise(0)


def value(surface: Column) -> Column:
    """Canonical decimal string of the first number of a figure, lakh and crore multiplied out."""
    whole = F.regexp_replace(F.regexp_extract(surface, NUMBER, 1), ",", "")
    digits = F.concat(whole, F.regexp_extract(surface, NUMBER, 2), F.repeat(F.lit("0"), power(surface)))
    at = F.length(whole) + power(surface)
    left = F.coalesce(F.nullif(F.ltrim(F.substr(digits, F.lit(1), at), F.lit("0")), F.lit("")), F.lit("0"))
    right = F.rtrim(F.substr(digits, at + 1), F.lit("0"))
    return F.when(right == "", left).otherwise(F.concat(left, F.lit("."), right))


def unit(surface: Column) -> Column:
    """percent, kw, rupee (a currency mark or ``/-``) or number; lakh and crore are part of the value."""
    low = F.lower(surface)
    return F.when(low.contains("%"), "percent").when(low.contains("kw"), "kw").when(low.rlike("rupee|rs|₹|/-"), "rupee").otherwise("number")


def kind(u: Column) -> Column:
    """What two quantities must share to compare: an amount may be written with or without its mark."""
    return F.when(u == "rupee", "number").otherwise(u)


def quantities(c: Column, grammar: str) -> Column:
    """array of (surface, start, end, value, unit) in the order of the text."""
    pattern = PATTERNS[grammar]
    no_value = F.lit(None).cast("string")

    def typed(z: Column) -> Column:
        start = z.end - F.length(z.surface)
        surface = F.btrim(F.lower(z.surface), F.lit(" ,")) if grammar == "stated" else z.surface
        return F.struct(
            surface.alias("surface"),
            start.alias("start"),
            (start + F.length(surface)).alias("end"),
            (no_value if grammar == "present" else value(z.surface)).alias("value"),
            (no_value if grammar == "present" else unit(z.surface)).alias("unit"),
        )

    def placed(text: Column) -> Column:
        pieces = F.struct(all_matches(text, pattern).alias("found"), F.split(text, pattern, -1).alias("gaps"))
        steps = lambda p: F.transform(p.found, lambda m, k: (F.length(m) + F.length(F.get(p.gaps, k))).cast("long"))
        return bound(pieces, lambda p: F.transform(F.arrays_zip(p.found.alias("surface"), bound(steps(p), running_totals).alias("end")), typed))

    some = text_or_empty(c).rlike(DIGIT)  # most texts have none
    return F.when(some, bound(read_by(c, grammar), placed)).otherwise(F.array().cast(TYPED))


def amounts(c: Column, grammar: str = "stated") -> Column:
    """Distinct (value, kind) of a text: what its figures are worth, however they are spelled."""
    return F.array_distinct(F.transform(quantities(c, grammar), amount))


def amount(x: Column) -> Column:
    return F.struct(x.value.alias("value"), kind(x.unit).alias("kind"))
