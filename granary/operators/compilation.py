"""Compile-time passes over records: integrity, contradictions, completeness, cross-checks, parity.

Every pass returns rows to report. A compile is all or nothing: ``write_if_clean`` writes nothing
while any error frame has a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quantities as Q
from ..functions.text import collapse
from ..sources import snapshot


def dangling(refs: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """References without a target; null references are none."""
    return refs.filter(F.col(on).isNotNull()).join(known.select(on).distinct(), on, "left_anti")


def contradictions(rows: DataFrame, key: list[str], value: str, out: str = "found") -> DataFrame:
    """Keys with more than one distinct value, with the sorted values."""
    g = rows.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ",").alias(out), F.count_distinct(value).alias("n"))
    return g.filter("n > 1")


def missing_members(universe: DataFrame, present: DataFrame, group: str, member: str) -> DataFrame:
    """Per group how many members of the universe (group, member) are absent, the smallest and largest of them, and all."""
    gap = universe.join(present, [group, member], "left_anti")
    return gap.groupBy(group).agg(F.count("*").alias("n_missing"), F.min(member).alias("first_missing"), F.max(member).alias("last_missing"))


def normalize_member(name: Column, aliases: DataFrame | dict[str, list[str]]) -> Column:
    """A member's canonical name; matching ignores case and outer blanks."""
    flat = [(a.strip().lower(), m) for m, names in aliases.items() for a in (m, *names)]
    table = F.create_map(*[F.lit(x) for kv in flat for x in kv])
    return F.coalesce(table[F.lower(F.trim(name))], F.trim(name)) if flat else F.trim(name)


def too_few(rows: DataFrame, key: str, item: str, least: int) -> DataFrame:
    """Keys with fewer than ``least`` distinct items."""
    return rows.groupBy(key).agg(F.count_distinct(item).alias("n")).filter(F.col("n") < least)


def figure_crosscheck(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """facts: fact_id, figure, page; pages: page, text. Figures found neither on their page nor on the next one.

    A null page cannot be checked and is not reported. The range of width one is an equi-join on the
    exploded page.
    """
    asked = facts.filter("page is not null and figure is not null").select("fact_id", "figure", F.explode(F.array(F.col("page"), F.col("page") + 1)).alias("page"))
    text = pages.select("page", collapse(F.col("text")).alias("t"))
    seen = asked.join(text, "page", "left").groupBy("fact_id", "figure").agg(F.max(F.coalesce(F.instr("t", F.col("figure")) > 0, F.lit(False))).alias("ok"))
    return seen.filter("not ok").select("fact_id", "figure")


def quantity_crosscheck(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """facts: fact_id, text, page; pages: page, text -> fact_id, value, kind of quantities found neither on the fact's page nor on the next one.

    Texts are read once; what is shuffled are distinct quantities, and the page after is the same quantity under
    the number before. A null page cannot be checked and is not reported.
    """
    amount = lambda rows, *by: rows.select(*by, F.explode(Q.amounts(F.col("text"))).alias("a")).select(*by, "a.*").distinct()
    stated = amount(facts.filter("page is not null"), "fact_id", "page")
    held = amount(pages, "page").select(F.explode(F.array(F.col("page"), F.col("page") - 1)).alias("page"), "value", "kind")
    return stated.join(held, ["page", "value", "kind"], "left_anti").select("fact_id", "value", "kind")


def required_values(pages: DataFrame, required: DataFrame) -> DataFrame:
    """required: value, first, last -> value, whether the pages first to last hold it, page breaks ignored."""
    p = pages.select("page", collapse(F.col("text")).alias("t"))
    hit = required.select("value", "first", "last", F.explode(F.sequence("first", "last")).alias("page")).join(p, "page", "left")
    g = hit.groupBy("value", "first", "last").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("t", F.lit("")).alias("t")))), lambda s: s.t), " ").alias("all"))
    return g.select("value", F.col("all").contains(F.col("value")).alias("present"))


def parity(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, kind): missing, added or changed, with the names of the changed fields."""
    o = old.select(key, *[F.col(f).alias(f"__o_{f}") for f in fields], F.lit(1).alias("__o"))
    n = new.select(key, *[F.col(f).alias(f"__n_{f}") for f in fields], F.lit(1).alias("__n"))
    both = o.join(n, key, "full_outer")
    diff = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"__o_{f}").eqNullSafe(F.col(f"__n_{f}")), F.lit(f)) for f in fields])), ",")
    kind = F.when(F.col("__n").isNull(), "missing").when(F.col("__o").isNull(), "added").when(diff != "", "changed")
    return both.select(key, kind.alias("kind"), F.when(kind == "changed", diff).otherwise(F.lit("")).alias("fields")).filter("kind is not null")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def same_hash(a: DataFrame, b: DataFrame, key: str, text: str) -> DataFrame:
    """Keys whose content differs byte for byte, or which only one side has."""
    h = lambda d, c: d.select(key, F.sha2(F.col(text).cast("binary"), 256).alias(c))
    return h(a, "old").join(h(b, "new"), key, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))


def set_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many keys are in both, only in the first, only in the second, and in either."""
    x, y = a.select(key).distinct().withColumn("__a", F.lit(1)), b.select(key).distinct().withColumn("__b", F.lit(1))
    both = x.join(y, key, "full_outer")
    return both.agg(F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("in_both"), F.count_if(F.col("__b").isNull()).alias("only_first"), F.count_if(F.col("__a").isNull()).alias("only_second"), F.count("*").alias("in_either"))


def stale_generated(existing: DataFrame, about_to_write: DataFrame, generated_by: str) -> DataFrame:
    """Generated rows that the next run won't write again; authored rows are never stale."""
    return existing.filter(F.col("generated_by") == generated_by).join(about_to_write.select("path").distinct(), "path", "left_anti")


def write_if_clean(frames: dict[str, DataFrame], errors: list[DataFrame], folder: str) -> int:
    """Publish all frames as one version below ``folder`` unless an error frame has a row; returns how many error frames have any.

    Each error frame is asked for one row; a write that fails midway leaves the earlier version (``sources/snapshot.py``).
    """
    try:
        snapshot.write(frames, folder, {str(k): e for k, e in enumerate(errors)})
    except snapshot.Rejected as e:
        return len(e.names)
    return 0


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def compliance_gaps(sources: DataFrame) -> DataFrame:
    """Sources that may not be fetched: an automated strategy needs a finished check and an allowing robots file; manual ones are exempt."""
    ok = F.coalesce(F.col("compliance_checked"), F.lit(False)) & (F.coalesce(F.col("robots"), F.lit("")) == "allowed")
    reason = F.when(~F.coalesce(F.col("compliance_checked"), F.lit(False)), "not checked").otherwise("robots")
    return sources.filter((F.col("fetch_strategy") != "manual") & ~ok).select("source_id", reason.alias("reason"))


def ratchet(found: int, baseline: int) -> tuple[bool, int]:
    """Whether a count of known defects has not grown, and the baseline from now on."""
    return found <= baseline, min(found, baseline)
