from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline as P
from granary.llm import near_copies as N
from granary.llm.common import read_table


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def kept(ids, texts, least=0.8):
    """Smallest id of each component of the pairs with Jaccard similarity 0.8 or more, by brute force."""
    sets, group = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    best = {}
    for k, i in enumerate(ids):
        best[find(k)] = min(i, best.get(find(k), i))
    return set(best.values())


def copies(seed, n, edits):
    """n texts with some words of one text replaced."""
    r = random.Random(seed)
    base, out = [f"w{r.randrange(9999)}" for _ in range(120)], []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_a_copy_of_similarity_over_four_fifths_goes(spark, make_docs, sf_dir):
    a = " ".join(f"w{k}" for k in range(200))
    near = a.replace("w50 ", "x ").replace("w120 ", "y ").replace("w180 ", "z ")
    far = near.replace("w20 ", "x ").replace("w80 ", "x ").replace("w150 ", "z ")
    assert [r.doc_id for r in P.near_dedup(spark, make_docs([a, near]), sf_dir).collect()] == [0]
    assert sorted(r.doc_id for r in P.near_dedup(spark, make_docs([a, far]), sf_dir).collect()) == [0, 1]


@pytest.mark.parametrize("block", [512, 7])
def test_groups_are_those_of_brute_force(spark, make_docs, block):
    texts = [t for s in range(12) for t in copies(s, 9, 6)] + copies(99, 60, 5) + ["a b c", "A  b\tc", "a b d", None, "", " \n"]
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    got = [r.doc_id for r in N.dedup(make_docs(texts, ids), block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == kept(ids, texts)


def test_stage_on_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    d = docs.select("doc_id", "text").toPandas()
    assert set(P.near_dedup(spark, docs, sf_dir).toPandas().doc_id) == kept(d.doc_id.tolist(), d.text.tolist())


def test_rows(spark, make_docs):
    docs = make_docs(["a b c d e f", "a b c d e f", "q r s", "a b c d e f", None], [3, 3, 5, None, 9]).selectExpr("*", "'mine' as __set")
    out = N.dedup(docs).collect()
    assert sorted(r.doc_id for r in out) == [3, 5, 9] and out[0]["__set"] == "mine"
    assert N.dedup(docs.limit(0)).count() == 0


def test_shared_keys_at_the_limit():
    r = np.random.default_rng(0)
    pool = r.integers(0, 1 << 64, (2000, 90), dtype=np.uint64)
    hit = [len(np.intersect1d(N.band_keys(N.minima(p[:81])), N.band_keys(N.minima(p[9:])))) > 0 for p in pool]  # 72 of 90: 0.8
    assert all(hit)


def test_sketches_at_the_limit():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 64, (2000, 90), dtype=np.uint64)
    for p in pool:
        assert len(N.agreeing(np.array([7, 8]), [N.sketch(N.minima(x)) for x in (p[:81], p[9:])])[0]) == 1


def test_agreeing_is_the_components_of_all_pairs():
    r = np.random.default_rng(2)
    base = r.integers(0, 256, (4, 160))
    m = base[r.integers(0, 4, 60)]
    m[r.random(m.shape) < r.choice([0.05, 0.2, 0.4], 60)[:, None]] = 0
    m = m.astype(np.uint8)
    near = (m[:, None] == m[None]).sum(axis=2) >= N.AGREE
    label = np.arange(60)
    for _ in range(60):
        label = np.where(near, label[None], 60).min(axis=1)
    got = np.arange(60)
    a, b = N.agreeing(np.arange(60), [x.tobytes() for x in m])
    got[b] = a
    assert (got == label).all()


def test_shared_boilerplate_makes_no_group(spark, make_docs):
    """3,000 texts with 120 of 180 words in common: keys are shared, groups aren't, and one planted copy goes."""
    r = random.Random(5)
    common = " ".join(f"b{k}" for k in range(120))
    texts = [common + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(3000)]
    texts.append(texts[7].replace("b60 ", "x "))
    docs = make_docs(texts)
    keyed = N.add_keys(docs.withColumn("raw", N.text_bytes("text")), "raw", "key", "bands", "sketch", "fp", N.SHINGLE)
    sizes = [x["count"] for x in N.candidates(keyed.select("key", "bands", "sketch", "fp")).groupBy("root").count().collect()]
    assert sum(n * (n - 1) // 2 for n in sizes) < 3001 * 3000 // 2 // 10_000
    assert {x.doc_id for x in N.dedup(docs).select("doc_id").collect()} == set(range(3000))
