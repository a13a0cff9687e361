"""Incremental compile: only notes that changed, and those that depend on them, are made again.

A note depends on every note that its references reach. Content hashes of two versions give the seeds
(changed, new and removed ids); a fixpoint over the reversed references of both versions adds their
dependents, a join of the last ring with the references in each round, until a round adds none. The compile function
then gets the affected notes and, to look things up in, all notes; rows of the others are taken
over. References to ids that don't exist yet count, so a note that resolves a dangling reference makes the
referring notes anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import held

HASHED = "content_hash"


def with_hash(notes: DataFrame, columns: list[str]) -> DataFrame:
    """Add the hash of the columns' values; null differs from empty, and fields can't run into each other."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return notes.withColumn(HASHED, F.sha2(F.concat(*[part(c) for c in columns]), 256))


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): new, changed or removed, from rows (key, content_hash)."""
    both = old.select(key, F.col(HASHED).alias("__old")).join(new.select(key, F.col(HASHED).alias("__new")), key, "full_outer")
    kind = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "changed")
    return both.select(key, kind.alias("change")).filter("change is not null")


def dependents(seeds: DataFrame, references: DataFrame, key: str, most_rounds: int | None = None) -> DataFrame:
    """(key, ring): seeds at ring 0, and every note from which references (src, dst) lead to a seed, at its distance.

    A ring is joined with the references once; notes that are known are left out, so cycles end.
    """
    back = held(references.select("src", "dst").filter("src <> dst").distinct())
    ring = held(seeds.select(key).distinct().withColumn("ring", F.lit(0)))
    known, at = ring, 0
    while (most_rounds is None or at < most_rounds) and not ring.isEmpty():
        at += 1
        reached = back.join(ring.select(F.col(key).alias("dst")), "dst").select(F.col("src").alias(key)).distinct()
        ring = held(reached.join(known.select(key), key, "left_anti").withColumn("ring", F.lit(at)))
        known = known.unionByName(ring)
        if at % 8 == 0:
            known = held(known)
    return known


def compile_delta(old_notes: DataFrame, old_compiled: DataFrame, new_notes: DataFrame, references: Callable[[DataFrame], DataFrame], compile_notes: Callable[[DataFrame, DataFrame], DataFrame], key: str, columns: list[str], most_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(compiled, report): the rows of a full compile of ``new_notes``, and (key, change, ring) of what was made again.

    ``references`` gives (src, dst) of notes; ``compile_notes(some, every)`` makes one row for each of
    ``some`` and may read of ``every`` what references reach within ``most_rounds`` steps (None: any).
    """
    old, new = with_hash(old_notes, columns), with_hash(new_notes, columns)
    changed = held(changes(old, new, key))
    links = references(old_notes).unionByName(references(new_notes))
    affected = held(dependents(changed, links, key, most_rounds))
    again = new_notes.join(affected.select(key), key, "left_semi")
    kept = old_compiled.join(affected.select(key), key, "left_anti")
    report = affected.join(changed, key, "left").withColumn("change", F.coalesce("change", F.lit("dependent")))
    return kept.unionByName(compile_notes(again, new_notes)), report.select(key, "change", "ring")
