from __future__ import annotations

import pandas as pd

import corpus_pipeline as P
from granary.llm import decontaminate, pii
from granary.llm.common import read_table

from .test_pipeline_stages import least_of_groups


def test_stages(spark, sf_dir, tmp_path):
    docs = read_table(spark, sf_dir, "documents")
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    frames = [docs.toPandas()]
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        frames.append(docs.toPandas())
    every, good, single, clean, private, coded = frames
    assert 0 < len(good) < len(every)
    # near duplicates: exactly one of each group of near copies, the one with the smallest id
    assert set(single.doc_id) == least_of_groups(dict(zip(good.doc_id, good.text, strict=True)))
    block = decontaminate.Items(items.item_id.tolist(), items.text.tolist())
    leaks = dict(zip(single.doc_id, decontaminate.matches(block, single.text.tolist()), strict=True))
    assert set(clean.doc_id) == {i for i in leaks if not leaks[i]}
    texts = clean.set_index("doc_id").text
    assert {i: t for i, t in zip(private.doc_id, private.text, strict=True)} == {i: pii.redact(t, pii.find_spans(t)) for i, t in texts.items()}
    assert (private.n_chars == private.text.str.len()).all()
    assert set(coded.doc_id) == set(private.doc_id) and coded.round_trip.all()


def test_run(spark, sf_dir):
    assert P.ORACLE_SQL is None and P.run(spark, sf_dir).count() > 0


def test_encode_samples_without_replacement(spark, make_docs):
    docs = make_docs(["some ordinary text, and more of it", "the cat sat on the mat", "", None])
    rows = {r.doc_id: r for r in dict(P.STAGES)["encode"](spark, docs, "").collect()}
    assert len(rows) == 4 and all(r.round_trip and r.samples[0].ids == r.ids for r in rows.values())
    drawn = [r.samples for r in rows.values() if r.n_pieces]
    assert len(drawn) == 2 and all(len(x) == 2 and x[0].ids != x[1].ids and x[0].value >= x[1].value for x in drawn)
    assert all(0 < s.inclusion < 1 for x in drawn for s in x)


def test_empty_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
