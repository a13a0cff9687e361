from __future__ import annotations

import os

import numpy as np
import pytest

from granary.llm import sentencepiece_sampling as S

if not os.path.exists(S.MODEL):
    pytest.skip("no vocabulary file", allow_module_level=True)


@pytest.fixture(scope="module")
def vocab():
    return S.vocabulary()


@pytest.fixture(scope="module")
def codec(vocab):
    return S.Codec(vocab)


def cells(batch, s):
    flat = batch.paths[s["path"]] if s["path"] >= 0 else np.zeros(0, np.int64)
    return batch.ids(flat[s["begin"] : s["end"]])[0]


def segmentations(vocab, word):
    weight = {p: (-np.log(r + S.OFFSET), i) for p, i, r in vocab["pieces"]}

    def go(s):
        return [()] if not s else [(s[:n], *rest) for n in range(1, min(16, len(s)) + 1) if s[:n] in weight for rest in go(s[n:])]

    return [(tuple(weight[p][1] for p in seg), sum(weight[p][0] for p in seg)) for seg in go(word)]


def test_samples_follow_the_distribution(vocab, codec):
    every = [(a + b, x + y) for a, x in segmentations(vocab, "▁the") for b, y in segmentations(vocab, "▁cat")]
    logp = np.array([w for _, w in every]) - np.logaddexp.reduce([w for _, w in every])
    number = {ids: k for k, (ids, _) in enumerate(every)}
    n = 8000
    batch = S.Batch(codec, ["the cat"] * n, S.mix(np.arange(n, dtype=np.uint64) * S.GOLD))
    found = batch.samples(3)
    first, second, total = np.zeros(len(every)), np.zeros(len(every)), 0.0
    for row in found:
        ks = [number[tuple(cells(batch, s).tolist())] for s in row]
        assert len(set(ks)) == 3 and row[0]["value"] >= row[1]["value"] >= row[2]["value"]
        assert all(abs(s["log_prob"] - logp[k]) < 1e-9 for s, k in zip(row, ks, strict=True))
        first[ks[0]] += 1
        second[ks[1]] += 1
        total += sum(np.exp(s["log_prob"]) / s["inclusion"] for s in row)
    p = np.exp(logp)
    want = np.array([sum(p[j] * p[k] / (1 - p[j]) for j in range(len(p)) if j != k) for k in range(len(p))])
    assert np.abs(first / n - p).max() < 0.02 and np.abs(second / n - want).max() < 0.02
    assert abs(total / n - 1) < 0.03  # inclusion scores make sums over samples unbiased


def test_all_segmentations_of_a_short_text(vocab, codec):
    every = segmentations(vocab, "▁on")
    batch = S.Batch(codec, ["on"], np.array([3], np.uint64))
    row = batch.samples(len(every) + 5)[0]
    assert {tuple(cells(batch, s).tolist()) for s in row} == {i for i, _ in every} and all(s["inclusion"] == 1 for s in row)


TEXTS = ["", "a", " ", "  two  blanks  ", "▁ literal mark", "日本語 ①\n\ttab", "é" * 300, "word " * 4000, "a" * 20_000, "\x00\x01", "<s> </s> <0x41>", "👩‍👩‍👧"]


def test_round_trip(spark, vocab, make_docs):
    docs = make_docs([*TEXTS, None], extra="").selectExpr("*", "'mine' as samples")
    rows = S.sample_segmentations(docs, vocab, ["doc_id"], ids=True).collect()
    codec = S.Codec(vocab)
    for r in rows:
        assert 1 <= len(r.samples) <= 2
        for s in r.samples:
            assert s.round_trip and S.decode(s.ids, codec) == (r.text or "") and s.n_pieces == len(s.ids)
        assert len({tuple(s.ids) for s in r.samples}) == len(r.samples)
    assert S.sample_segmentations(docs.limit(0), vocab, ["doc_id"]).count() == 0


def test_same_library_decoding(vocab):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    batch = S.Batch(S.Codec(vocab), ["some ordinary text, écrit ici"], np.array([1], np.uint64))
    for s in batch.samples(3)[0]:
        assert sp.decode(cells(batch, s).tolist()) == "some ordinary text, écrit ici"


def test_rows_do_not_depend_on_each_other(codec):
    keys = np.array([5, 6, 7], np.uint64)
    together = S.Batch(codec, ["one two", "three", "one two"], keys)
    alone = S.Batch(codec, ["one two"], keys[2:])
    a, b = together.samples(2)[2], alone.samples(2)[0]
    assert [cells(together, s).tolist() for s in a] == [cells(alone, s).tolist() for s in b]


def test_memory_of_a_batch(codec):
    import tracemalloc

    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("etaoinshrdlu"), n)) for n in rng.integers(2, 10, 60_000)]
    texts, size = [], 0
    while size < S.BATCH:
        texts.append(" ".join(rng.choice(words, 300)))
        size += len(texts[-1])
    tracemalloc.start()
    try:
        S.Batch(codec, texts, np.arange(len(texts), dtype=np.uint64)).samples(2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 160e6  # 220 MB with batches of 2.6 MB


def test_cuts_of_batches_change_nothing(spark, vocab, make_docs, monkeypatch):
    docs = make_docs([*TEXTS, None, *(f"text {k} of many" for k in range(40))], extra="x")
    columns = ["doc_id", "text", "s.rank", "s.n_pieces", "s.ids_hash", "s.ids", "s.round_trip", "s.log_prob"]

    def rows(keep=None):
        found = S.sample_segmentations(docs, vocab, ["doc_id"], ids=True, keep=keep)
        return found, sorted(found.selectExpr("*", "explode(samples) as s").select([c for c in columns if c != "text"]).collect(), key=lambda r: (r.doc_id, r.rank))

    found, whole = rows()
    assert found.columns == [*docs.columns, "samples"]
    monkeypatch.setattr(S, "BATCH", 50)
    found, cut = rows(["doc_id"])
    assert found.columns == ["doc_id", "samples"]
    assert [r[:-1] for r in whole] == [r[:-1] for r in cut]
    assert np.allclose([r.log_prob for r in whole], [r.log_prob for r in cut], rtol=1e-9, atol=1e-6)


def test_arrow_samples_are_those_of_the_batch(codec):
    keys = np.array([5, 6, 7], np.uint64)
    texts = ["one two", "", "é퟿n"]
    got = S.encode_batch(codec, S.Hasher(), texts, keys, 3, True).to_pylist()
    batch = S.Batch(codec, texts, keys)
    for row, want, text in zip(got, batch.samples(3), texts, strict=True):
        assert [(s["rank"], s["log_prob"], s["value"], s["inclusion"], s["ids"]) for s in row] == [(k + 1, s["log_prob"], s["value"], s["inclusion"], cells(batch, s).tolist()) for k, s in enumerate(want)]
        assert all(s["round_trip"] and S.decode(s["ids"], codec) == text and s["n_pieces"] == len(s["ids"]) for s in row)
    assert S.encode_batch(codec, S.Hasher(), [], keys[:0], 3, False).to_pylist() == []
