"""Guards on answers: figures, citations, agreement with a record, disclosure of ambiguities.

``compat`` reproduces two slips of the behaviour this engine replaces: figures are compared in lower
case with a context that is not, and by containment rather than by token. The default compares sets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.quantities import amount, amounts, bound, quantities
from ..functions.text import DISCLOSURE_WORDS, citation_numbers, figures, normalize_figures, text_or_empty


def leaked_figures(answer: Column, context: Column, compat: bool = False) -> Column:
    """Figures of the answer that the context doesn't have."""
    if compat:
        plain = normalize_figures(context)
        return F.filter(figures(answer), lambda f: ~plain.contains(f))
    return F.array_except(figures(answer), figures(context))


def leaked_quantities(answer: Column, context: Column) -> Column:
    """Quantities of the answer that the context doesn't have, by value: 10 Crore stands for 100000000. The answer's own spellings are returned."""
    strange = bound(amounts(context), lambda known: F.filter(quantities(answer, "stated"), lambda x: ~F.array_contains(known, amount(x))))
    return F.array_distinct(F.transform(strange, lambda x: x.surface))


def invalid_citations(answer: Column, sources: Column) -> Column:
    return F.filter(citation_numbers(answer), lambda n: (n < 1) | (n > sources))


def mismatched_figures(answer: Column, truth: Column) -> Column:
    """Rate-shaped figures (percent, unit or currency) of the answer that the record lacks."""
    return mismatched(figures(answer), truth)


def mismatched(found: Column, truth: Column) -> Column:
    """``mismatched_figures`` of an answer's figures."""
    return F.array_except(F.filter(found, lambda f: f.rlike("%|crore|lakh|rupee")), figures(truth))


def undisclosed(answer: Column, ids: Column) -> Column:
    """Ids that the answer neither names nor covers by a word of uncertainty."""
    low = F.lower(text_or_empty(answer))
    said = low.rlike("|".join(DISCLOSURE_WORDS))
    return F.when(said, F.array().cast("array<string>")).otherwise(F.filter(ids, lambda i: ~low.contains(F.lower(i))))
