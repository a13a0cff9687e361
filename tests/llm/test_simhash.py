from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from granary.llm import simhash as S
from granary.llm.components import connected_components


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def same_partition(a: dict, b: dict) -> bool:
    return len({(a[k], b[k]) for k in a}) == len(set(a.values())) == len(set(b.values()))


@pytest.mark.parametrize("text", ["", None, "One", "a b c", "a b c d", "A\tB\x0bc  É d É", "x " * 70_000, "w1 w2 w3 w4 w5 w1 w2 w3 w4 w5"])
def test_fingerprint(text):
    assert S.fingerprint((text or "").encode()) == plain_fingerprint(text)


def cloud(seed, centres=12, members=40, spread=7):
    """Fingerprints in tight clouds, some linked through chains only, and some far from all others."""
    r = random.Random(seed)
    out = {0, (1 << 64) - 1}
    for _ in range(centres):
        c = r.getrandbits(64)
        for _ in range(members):
            x = c
            for _ in range(r.randint(0, spread)):
                x ^= 1 << r.randrange(64)
            out.add(x)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("case", ["planned", "t1", "t2", "small_blocks", "unequal"])
def test_links_have_the_components_of_all_pairs(spark, seed, case):
    fps = cloud(seed)
    split = lambda n: [list(map(int, x)) for x in np.array_split(np.arange(64), n)]
    parts, block = {"planned": (None, 512), "t1": ([(b, 1) for b in split(2)] + [], 512), "t2": ([(split(3)[0], 2), (split(3)[1], 0), (split(3)[2], 0)], 64), "small_blocks": ([(b, 0) for b in split(5)], 7), "unequal": ([(split(4)[0], 1), *[(b, 0) for b in split(4)[1:]]], 16)}[case]
    if case == "t1":
        parts = [(split(2)[0], 2), (split(2)[1], 1)]
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = S.link(df, block=block, parts=parts).collect()
    nodes = fps.view(np.int64).tolist()
    near = [(nodes[i], nodes[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4) + i + 1]
    assert same_partition(roots(nodes, [(r.a, r.b) for r in got]), roots(nodes, near))


@pytest.mark.parametrize("n", [0, 1, 1000, 10**6, 10**9])
def test_plan_satisfies_the_pigeonhole_bound(n):
    parts = S.plan(cloud(5), n)
    assert sum(t + 1 for _, t in parts) == S.MOST + 1
    bits = [b for p, _ in parts for b in p]
    assert len(bits) == len(set(bits))


def test_larger_inputs_choose_wider_keys():
    few, many = S.plan(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64), 10**4), S.plan(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64), 10**9)
    assert min(len(b) for b, _ in many) > min(len(b) for b, _ in few)


def test_allot_is_the_best():
    import itertools

    r = random.Random(1)
    for _ in range(30):
        costs = [[0.0, *sorted(r.random() * 10 for _ in range(3))] for _ in range(4)]
        best = min(sum(c[k] for c, k in zip(costs, ks, strict=True)) for ks in itertools.product(range(4), repeat=4) if sum(ks) == 5)
        assert S.allot(costs, 5)[0] == pytest.approx(best)


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(k, k + 1) for k in range(200)], [(0, k) for k in range(1, 300)], [(random.Random(k).randrange(120), random.Random(k + 999).randrange(120)) for k in range(90)]])
def test_components(spark, pairs):
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"))
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    have = {r.node: r.root for r in got.collect()}
    assert set(have) == nodes
    if nodes:
        assert same_partition(have, roots(nodes, pairs))


def test_rows(spark, make_docs):
    base = " ".join(f"w{k}" for k in range(200))
    texts = [base, base, base + " end", None, "", "other words entirely here " * 9, base]
    got = {(r.doc_id, r.fp): r.component_id for r in S.near_duplicates(make_docs(texts, [5, 3, 9, 8, 7, 6, None]).selectExpr("*", "1 as fp", "2 as component_id")).collect()}
    by_id = {k[0]: v for k, v in got.items()}
    assert len(got) == 7 and by_id[5] == by_id[3] == by_id[9] == by_id[None] == 3 and by_id[8] == by_id[7] == 7 and by_id[6] == 6


def test_dedup_keeps_one_row_of_each_group(spark, make_docs):
    base = " ".join(f"w{k}" for k in range(200))
    docs = make_docs([base, base, base + " end", base, None, "x y z q"], [3, 3, 9, None, 4, 5]).withColumn("__fp", F.lit("mine"))
    kept = S.dedup(docs).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4, 5] and kept[0]["__fp"] == "mine"
    assert S.dedup(docs.limit(0)).count() == 0 and S.near_duplicates(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    import pandas as pd

    d = pd.read_parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in S.op4_simhash(spark, sf_dir).collect()}
    fp = {i: plain_fingerprint(t) for i, t in zip(d.doc_id, d.text, strict=True)}
    assert {i: f"{x:016x}" for i, x in fp.items()} == {i: r.fingerprint for i, r in got.items()}
    ids = sorted(fp)
    want = roots(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    least = {}
    for i in ids:
        least[want[i]] = min(i, least.get(want[i], i))
    assert {i: r.component_id for i, r in got.items()} == {i: least[want[i]] for i in ids}


def test_deep_thresholds_are_planned():
    """All thresholds up to the distance are open to the plan; estimates of deep ones agree with a count of all pairs."""
    rng = np.random.default_rng(3)
    sample = np.unique(rng.integers(0, 1 << 64, 1500, dtype=np.uint64) & np.uint64(0x0F0F00FF00000FFF))
    bits = list(range(0, 32))
    got = S.sample_pairs(sample, bits, 4)
    masked = sample & np.uint64(S.mask_of(bits))
    apart = np.bitwise_count(masked[:, None] ^ masked[None, :])
    want = [((apart <= t).sum() - len(sample)) / 2 for t in range(5)]
    assert got == want and len(S.allot([[0.0, 9, 9, 9, 9, 1.0], [0.0, 9, 9, 9, 9, 9]], 5)[1]) == 2 and S.allot([[0.0, 9, 9, 9, 9, 1.0], [0.0, 9, 9, 9, 9, 9]], 5)[1] == [4, -1]
    rows = S.plan(sample, 10**6, 4)
    assert sum(t + 1 for _, t in rows) == 5
