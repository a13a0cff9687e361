"""Retrieval as one operator against a plain reading, and what reaches the scorer."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from granary.operators import retrieve as RT

Q = "query_id long, variant int, text string, embedding array<double>"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randrange(1, 40))), "en" if i % 3 else "fr", [rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)]) for i in range(200)]
    rows += [(500 + i, rows[0][1], "en", rows[0][3]) for i in range(100)]  # a third are copies
    rows += [(900, None, "en", None), (901, "", None, [0.0] * 4)]
    asked = [(q, v, " ".join(rng.choices(vocab, k=5)), [rng.uniform(-1, 1) for _ in range(4)]) for q in range(8) for v in (0, 1)]
    asked += [(20, 0, "w1 w2", None), (21, 0, None, [1.0, 1.0, 0.0, 0.0]), (22, 0, "unheard", None), (23, 0, None, None), (23, 1, "w3", None)]
    return rows, asked


def plain(rows, asked, top):
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    best = lambda d, k: {i: r for r, (_, i) in enumerate(sorted((-s, i) for i, s in d.items())[:k], 1)}
    merged: dict[int, dict] = {}
    for q, _, text, e in asked:
        dense = {} if e is None else {i: round(sum(a * b for a, b in zip(e, v, strict=True)) / math.sqrt(sum(a * a for a in e) * sum(b * b for b in v)), 6) for i, _, _, v in rows if v and any(v)}
        sparse = {i: n for i, t, _, _ in rows if (n := sum(words(t).count(w) * words(text).count(w) for w in set(words(text))))}
        d, s = best(dense, 30), best(sparse, 30)
        fused = {i: round(sum(1 / (60 + x[i]) for x in (d, s) if i in x), 9) for i in d | s}
        for i, r in best(fused, top).items():
            merged.setdefault(q, {}).setdefault(i, []).append(1 / (60 + r))
    own, by_id = {q: t for q, v, t, _ in asked if v == 0}, {r[0]: r for r in rows}
    out = {}
    for q, text in own.items():
        short = {i: round(sum(x), 9) for i, x in merged.get(q, {}).items()}
        w = set(words(text))
        out[q] = {i: round(1 / (1 + math.exp(4 - 8 * len(w & set(words(by_id[i][1]))) / max(1, len(w)))), 6) for i in best(short, top)}
    return out, {q: best(x, top) for q, x in out.items()}


def test_retrieve_equals_a_plain_reading_and_scores_a_pair_once(spark, corpus, tmp_path):
    rows, asked = corpus
    seen = str(tmp_path / "seen")

    def counting(questions, texts):
        assert 0 < len(texts) <= RT.PAIRS
        with open(seen, "a") as f:
            f.write(f"{len(texts)}\n")
        return RT.lexical_scorer(questions, texts)

    texts = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(3)
    vectors = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, embedding array<double>")
    limits = spark.createDataFrame([("fr", 0.9, 0.95), ("default", 0.2, 0.6)], "source_type string, tau_hard double, tau_soft double")
    got = RT.retrieve(spark.createDataFrame(asked, Q), texts, vectors, limits, "lang", counting).collect()
    scores, ranks = plain(rows, asked, RT.SHORTLIST)
    assert {(r.query_id, r.doc_id): (r.score, r["rank"]) for r in got if r.doc_id is not None} == {(q, i): (s, ranks[q][i]) for q, x in scores.items() for i, s in x.items()}
    assert {r.query_id for r in got} == {a[0] for a in asked}
    langs = {r[0]: r[2] for r in rows}
    for r in got:
        first = next((i for i, k in ranks[r.query_id].items() if k == 1), None)
        hard, soft = (0.9, 0.95) if first is not None and langs[first] == "fr" else (0.2, 0.6)
        top = scores[r.query_id][first] if first is not None else 0.0
        assert r.top_score == top and r.action == ("abstain" if top < hard else "answer_low_confidence" if top < soft else "answer")
    assert [r.doc_id for r in got if r.query_id == 22] == [None]
    with open(seen) as f:
        assert sum(map(int, f)) == sum(map(len, scores.values()))


def test_empty_inputs(spark, corpus):
    rows, asked = corpus
    texts = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    vectors = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, embedding array<double>")
    q = spark.createDataFrame(asked, Q)
    assert RT.retrieve(q.limit(0), texts, vectors, None, "lang").count() == 0
    assert {(r.action, r.doc_id) for r in RT.retrieve(q, texts.limit(0), vectors.limit(0), None, "lang").collect()} == {("abstain", None)}


def test_batches_are_bounded(spark):
    import pyarrow as pa

    sizes = []

    def scorer(asked, texts):
        sizes.append([len(t or "") for t in texts])
        return np.zeros(len(texts))

    texts = [None, "", *["x" * n for n in (3, 10, 10, 40, 41, 500)]]
    batch = pa.RecordBatch.from_pydict({"query_id": list(range(8)), "doc_id": list(range(8)), "query_text": ["q"] * 8, "text": texts})
    out = list(RT.in_batches(scorer, pairs=3, chars=50)([batch]))
    assert out[0].num_rows == 8 and [n for s in sizes for n in s] == [len(t or "") for t in texts]
    assert all(len(s) <= 3 and (sum(s) <= 50 or len(s) == 1) for s in sizes)
