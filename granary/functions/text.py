"""Column functions over text: normalisation, tokens, figures, links, slugs, language and intent.

All are built-in expressions, so Catalyst keeps them inside whole-stage code. Patterns around
non-ASCII words use explicit delimiters: engines disagree about \\b next to combining marks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
#: Romanised words that mark a question as Hinglish.
HINGLISH = (
    "kitni", "kitna", "milegi", "milega", "subsidy", "udyami", "udyog", "karobar", "chahiye", "kaise", "kya",
    "hai", "hain", "yojana", "paisa", "paise", "sahayata", "lakh", "crore", "jile", "jila", "vyapar",
)
HINGLISH_SHARE = 0.15
#: Intents in the order in which they are tried.
INTENTS = (
    ("greeting", r"(?i)^\s*(hi|hello|hey|namaste|namaskar)\b"),
    ("grievance", r"(?i)\bcomplain(t|ing)?\b|\bgrievance\b|\bnot (received|working|responding)\b|(^|[\s,.?!।])शिकायत([\s,.?!।]|$)"),
    ("calculation_request", r"(?i)\bhow much (will|would|do) i (get|receive)\b|\bmy investment (is|will be)\b|\bcalculate\b|(^|[\s,.?!।])(मुझे कितन[ीा]|मेरा निवेश)([\s,.?!।]|$)"),
)
EXPLANATORY = r"(?i)\bwhy\b|\bexplain\b|\bhow does\b|\bwhat condition|\beligib(le|ility)\b|(^|[\s,.?!।])क्यों([\s,.?!।]|$)|(^|[\s,.?!।])शर्त"
LOOKUP = r"(?i)\b(what|how much|rate|cap|percentage|kitn[iā]|kya hai)\b|(^|[\s,.?!।])(कितन[ीा]|क्या है)([\s,.?!।]|$)"
#: Enterprise categories in the order in which they are tried.
CATEGORIES = (("micro", r"(?i)\bmicro\b|सूक्ष्म"), ("small", r"(?i)\bsmall\b|लघु"), ("medium", r"(?i)\bmedium\b|मध्यम"))
#: Unit spellings (the source's own slips included) and what they count as.
UNITS = ((r"(?i)\bcroe\b", "crore"), (r"(?i)\bcror(es)?\b", "crore"), (r"(?i)\bcrores\b", "crore"), (r"करोड़?", "crore"), (r"(?i)\blakhs?\b", "lakh"), (r"लाख", "lakh"), (r"(?i)₹|\bRs\.?,?\s?|\bINR\b", "RUPEE "))
FIGURE = r"(?i)(?:RUPEE\s?)?\d[\d,]*(?:\.\d+)?\s*(?:%|crore|lakh|kw)?"
#: What ends no number, tag or currency mark, and a blank: no figure reaches over it.
NO_FIGURE = r"[^\s0-9०-९,.\]₹EeRrSs]\s"
DISCLOSURE_WORDS = ("clarification", "not specified", "unclear", "cannot be determined", "not defined")
#: Letters that have no capital of one letter (or one that is newer than the tables of SQL engines), and those whose capital of one letter differs from the full mapping.
NO_CAPITAL = (
    "\u0149\u019b\u01f0\u0264\u0390\u03b0\u0587\u1c8a\u1e96-\u1e9a\u1f50\u1f52\u1f54\u1f56\u1f88-\u1f8f\u1f98-\u1f9f\u1fa8-\u1faf\u1fb2\u1fb4\u1fb6-\u1fb7\u1fbc\u1fc2\u1fc4\u1fc6-\u1fc7\u1fcc"
    "\u1fd2-\u1fd3\u1fd6-\u1fd7\u1fe2-\u1fe4\u1fe6-\u1fe7\u1ff2\u1ff4\u1ff6-\u1ff7\u1ffc\ua7cd\ua7db\ufb00-\ufb06\ufb13-\ufb17\U00010d70-\U00010d85"
)
ONE_CAPITAL = (
    "\xdf\u1f80\u1f81\u1f82\u1f83\u1f84\u1f85\u1f86\u1f87\u1f90\u1f91\u1f92\u1f93\u1f94\u1f95\u1f96\u1f97\u1fa0\u1fa1\u1fa2\u1fa3\u1fa4\u1fa5\u1fa6\u1fa7\u1fb3\u1fc3\u1ff3",
    "\u1e9e\u1f88\u1f89\u1f8a\u1f8b\u1f8c\u1f8d\u1f8e\u1f8f\u1f98\u1f99\u1f9a\u1f9b\u1f9c\u1f9d\u1f9e\u1f9f\u1fa8\u1fa9\u1faa\u1fab\u1fac\u1fad\u1fae\u1faf\u1fbc\u1fcc\u1ffc",
)
LIFECYCLE = {"verified": "stable", "unverified": "stable", "superseded": "deprecated", "disputed": "draft"}
# ----------------------------------------------------------------------------------------------


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(pattern), F.lit(group))


def alnum(c: Column) -> Column:
    """Lower-case letters and digits, other runs as single blanks."""
    return F.array_join(all_matches(F.lower(c), "[a-z0-9]+"), " ")


def alnum_plain(c: Column) -> Column:
    """The words of ``alnum_words`` with single blanks between, and perhaps one at an end."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")


def alnum_words(c: Column) -> Column:
    return all_matches(F.lower(c), "[a-z0-9]+")


def alpha_words(c: Column) -> Column:
    return all_matches(F.lower(c), "[a-z]+")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " "))


def simple_upper(c: Column) -> Column:
    """Capitals letter by letter, as SQL engines give them: \u00df becomes \u1e9e, not SS, and no text grows."""
    special = f"[{NO_CAPITAL}{ONE_CAPITAL[0]}]"
    pieces = F.regexp_extract_all(c, F.lit(f"{special}+|[^{special[1:]}+"), F.lit(0))
    each = F.transform(pieces, lambda x: F.when(x.rlike(f"^{special}"), F.translate(x, *ONE_CAPITAL)).otherwise(F.upper(x)))
    return F.when(c.rlike(special), F.array_join(each, "")).otherwise(F.upper(c))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def detect_language(c: Column) -> Column:
    """hi if any Devanagari letter, hinglish by the share of marked words, else en."""
    words = alpha_words(c)
    marked = F.size(F.filter(words, lambda w: w.isin(*HINGLISH)))
    share = marked / F.greatest(F.size(words), F.lit(1))
    return F.when(text_or_empty(c).rlike("[ऀ-ॿ]"), "hi").when((F.size(words) > 0) & (share >= HINGLISH_SHARE), "hinglish").otherwise("en")


def answer_language(language: Column) -> Column:
    return F.when(language == "hi", "hi").otherwise("en")


def classify_intent(c: Column) -> Column:
    out = F
    for name, pattern in INTENTS:
        out = out.when(text_or_empty(c).rlike(pattern), name)
    return out.otherwise("policy_qa")


def detect_category(c: Column) -> Column:
    out = F
    for name, pattern in CATEGORIES:
        out = out.when(text_or_empty(c).rlike(pattern), name)
    return out.otherwise(F.lit(None).cast("string"))


def is_explanatory(c: Column) -> Column:
    return text_or_empty(c).rlike(EXPLANATORY)


def is_lookup(c: Column) -> Column:
    return text_or_empty(c).rlike(LOOKUP)


def normalize_figures(c: Column) -> Column:
    """Latin digits, one spelling for each unit and currency mark, single blanks."""
    out = F.translate(text_or_empty(c), "०१२३४५६७८९", "0123456789")
    out = reduce(lambda x, u: F.regexp_replace(x, u[0], u[1]), UNITS, out)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def figures(c: Column) -> Column:
    """Distinct figures of a text in order, lower-case, citation tags left out."""
    plain = normalize_figures(F.regexp_replace(text_or_empty(c), r"\[S\d+\]", " "))
    found = F.transform(all_matches(plain, FIGURE), lambda x: F.lower(F.regexp_replace(F.btrim(x, F.lit(" ,")), r"\s+", " ")))
    return F.array_distinct(F.filter(found, lambda x: x.rlike(r"\d")))


def figure_parts(c: Column) -> Column:
    """(figures, edge) of a text, so that texts joined by line breaks have the figures of all and those of their edges joined.

    The edge is the text up to the first place and from the last one that no figure reaches over (``NO_FIGURE``); a
    text without such a place is all edge. Nulls have a null edge, which a join leaves out.
    """
    head = F.regexp_extract(c, rf"(?s)^.*?{NO_FIGURE}", 0)
    tail = F.regexp_extract(c, rf"(?s)^.*{NO_FIGURE}(.*)$", 1)
    inner = F.substring(c, F.length(head) + 1, F.length(c) - F.length(head) - F.length(tail))
    return F.struct(F.when(head == "", F.array().cast("array<string>")).otherwise(figures(inner)).alias("figures"), F.when(head == "", c).otherwise(F.concat(head, tail)).alias("edge"))


def citation_numbers(c: Column) -> Column:
    return F.transform(all_matches(c, r"\[S(\d+)\]", 1), lambda x: x.cast("int"))


def markdown_links(c: Column) -> Column:
    """(text, target) of inline links; images are not links."""
    pattern = r"(?:^|[^!])\[([^\]]*)\]\(([^)\s]+)\)"
    return F.transform(F.arrays_zip(all_matches(c, pattern, 1).alias("label"), all_matches(c, pattern, 2).alias("target")), lambda x: F.struct(x.label.alias("label"), x.target.alias("target")))


def wikilinks(c: Column) -> Column:
    return F.transform(all_matches(c, r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]", 1), lambda x: F.trim(x))


def footnotes(c: Column) -> Column:
    return F.array_distinct(all_matches(c, r"\[\^([^\]]+)\]", 1))


def slug_upper(c: Column, most: int = 60) -> Column:
    return F.btrim(F.left(F.btrim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "-"), F.lit("-")), F.lit(most)), F.lit("-"))


def slug_lower(c: Column, most: int = 40) -> Column:
    return F.left(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(most))


def slug_id(c: Column, most: int = 40) -> Column:
    """Lower-case id part; dots, underscores and dashes stay."""
    return F.btrim(F.left(F.regexp_replace(F.lower(c), r"[^a-z0-9._-]+", "-"), F.lit(most)), F.lit("-"))


def slug_name(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def concept_id(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"\.md$", "")


def chunk_id(scheme: Column, version: Column, *parts: Column) -> Column:
    return F.concat_ws(".", F.lower(scheme), slug_id(version), *[slug_id(p) for p in parts])


def local_id(scheme: Column, namespaced: Column) -> Column:
    prefix = F.concat(scheme, F.lit("-"))
    return F.when(namespaced.startswith(prefix), F.substring(namespaced, F.length(prefix) + 1, F.length(namespaced))).otherwise(namespaced)


def first_filled(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])


def one_line(c: Column, most: int = 200) -> Column:
    flat = collapse(c)
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 3)), F.lit("..."))).otherwise(flat)


def trust_tier(actors: Column) -> Column:
    """unverified without actors, human-reviewed with a human one, else machine-confirmed."""
    return F.when(F.coalesce(F.size(actors), F.lit(0)) <= 0, "unverified").when(F.exists(actors, lambda a: a.startswith("human:")), "human-reviewed").otherwise("machine-confirmed")


def actors_of(verifier: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """Actors whose pattern a free-text verifier matches, in order; an unknown one becomes a process."""
    known = F.array_compact(F.array(*[F.when(verifier.rlike(p), F.lit(a)) for p, a in patterns]))
    other = F.array(F.concat(F.lit("process:"), F.coalesce(F.nullif(slug_lower(verifier), F.lit("")), F.lit("unknown"))))
    return F.when(F.coalesce(F.trim(verifier), F.lit("")) == "", F.array().cast("array<string>")).when(F.size(known) > 0, known).otherwise(other)


def lifecycle(status: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LIFECYCLE.items() for x in kv])[status], F.lit("stable"))
