"""Stages after the classifier held against brute force; near copies by exact Jaccard of five-word shingles."""

from __future__ import annotations

import re

import pandas as pd

import corpus_pipeline as P
from granary.llm import decontaminate, pii
from granary.llm.common import read_table

STAGE = dict(P.STAGES)


def shingles(text: str, size: int = 5) -> frozenset:
    """Sets of lower-case word shingles (a shorter text: all its words)."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def least_of_groups(texts: dict[int, str], least: float = 0.8) -> set[int]:
    """The smallest id of each group of texts that similar pairs link, all pairs looked at."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {top(i) for i in ids}


def test_near_copies_of_the_stage(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    kept = STAGE["near_dedup"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in kept.collect()} == least_of_groups(texts)


def test_stages_after_near_dedup(spark, sf_dir, tmp_path):
    docs = read_table(spark, sf_dir, "documents")
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    before = docs.toPandas()
    clean = STAGE["decontamination"](spark, docs, sf_dir).toPandas()
    block = decontaminate.Items(items.item_id.tolist(), items.text.tolist())
    leaks = dict(zip(before.doc_id, decontaminate.matches(block, before.text.tolist()), strict=True))
    assert sorted(clean.doc_id) == sorted(i for i in leaks if not leaks[i])

    private = STAGE["personal_data"](spark, docs, sf_dir)
    assert private.columns == docs.columns
    private.write.parquet(str(tmp_path / "private"))
    private = spark.read.parquet(str(tmp_path / "private"))
    rows = private.toPandas()
    texts = dict(zip(before.doc_id, before.text, strict=True))
    assert dict(zip(rows.doc_id, rows.text, strict=True)) == {i: pii.redact(t, pii.find_spans(t)) for i, t in texts.items()}
    assert (rows.n_chars == rows.text.str.len()).all()

    coded = STAGE["encode"](spark, private, sf_dir).toPandas()
    assert sorted(coded.doc_id) == sorted(rows.doc_id) and coded.round_trip.all()
