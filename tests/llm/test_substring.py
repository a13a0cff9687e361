from __future__ import annotations

import numpy as np
import pytest

from granary.llm import common
from granary.llm import substring_dedup as S
from granary.llm.wordhash import Hasher


def plain(rows):
    """(n_words, n_removed, kept) for each row by the definition."""
    first, words = {}, []
    order = lambda i: (1 << 63) - 1 if i is None else i
    for i, t in rows:
        w = (t or "").encode().split()
        words.append(w)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(order(i), first.get(key, order(i)))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < order(i) for j in range(k, k + 13)}
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ord", "1 as k1")
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in S.dedup(df).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("seed, letters", [(0, "ab"), (1, "abcdef"), (2, "a"), (3, "abcdefghijklmnop")])
def test_random_documents(spark, seed, letters):
    r = np.random.default_rng(seed)
    pool = [" ".join(r.choice(list(letters), r.integers(5, 60))) for _ in range(12)]
    texts = [" ".join(r.choice(pool, r.integers(0, 5))) + " " + " ".join(r.choice(list(letters), r.integers(0, 20))) for _ in range(60)]
    ids = r.permutation(60).tolist()
    check(spark, list(zip(ids, texts, strict=True)))


def test_edges(spark):
    run = " ".join(f"w{k}" for k in range(40))
    rows = [(1, run), (2, run), (2, "x " + run), (None, run), (None, None), (3, ""), (4, None), (5, " ".join(f"w{k}" for k in range(12))), (6, "\t".join(f"w{k}" for k in range(13))), (7, run), (7, run), (0, "é " * 14), (9, "é\n" * 30), (10, "q" * 5000 + " " + run)]
    check(spark, rows)


def test_boundaries_of_shared_passages(spark):
    r = np.random.default_rng(9)
    passage = [f"p{k}" for k in range(70)]
    rows = []
    for k in range(40):
        a, n = int(r.integers(0, 58)), int(r.integers(11, 60))
        rows.append((k, " ".join([f"u{k}x{j}" for j in range(int(r.integers(0, 9)))] + passage[a : a + n] + [f"v{k}x{j}" for j in range(int(r.integers(0, 9)))])))
    check(spark, rows)


def test_empty_table(spark):
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hashes_do_not_depend_on_place():
    h = Hasher()
    a, *_ = h.words([b"alpha beta gamma"])
    b, *_ = h.words([b"zz", b"", b"  beta\tgamma alpha", b"x" * 600, b"q " + b"x" * 600])
    assert b[1:4].tolist() == [a[1], a[2], a[0]] and b[4] == b[6]
    assert h.spans(a, np.array([1]), np.array([3]))[0] == h.spans(b, np.array([1]), np.array([3]))[0]


def test_query(spark, sf_dir):
    import hashlib

    import pandas as pd

    d = pd.read_parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in S.op7_substring_dedup(spark, sf_dir).collect()}
    for i, n, gone, kept in plain(list(zip(d.doc_id.tolist(), d.text, strict=True))):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, gone, hashlib.sha256(kept).hexdigest())


def test_words_decide_where_polynomial_hashes_agree(spark):
    """The Thue-Morse sequence and its complement have equal polynomial hashes modulo a power of two, whatever the base."""
    bits = [bin(k).count("1") & 1 for k in range(1 << 10)]
    rows = [(1, "x " + " ".join(("red", "blue")[b] for b in bits)), (2, "x " + " ".join(("blue", "red")[b] for b in bits))]
    check(spark, rows)


def test_hot_anchors_are_broadcast_with_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 1 << 40)
    r = np.random.default_rng(5)
    passage = " ".join(f"p{k}" for k in range(30))
    check(spark, [(k, f"u{k} " * int(r.integers(0, 3)) + passage + f" v{k % 4}" * int(r.integers(0, 20))) for k in range(40)])


def test_repeats_are_maximal_and_name_their_source(spark):
    a, b = ([f"{c}{k}" for k in range(40)] for c in "ab")
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(["x", "y", *a[5:35], "z", *b, "w"])), (4, " ".join(a[:12]))]
    got = {r.doc_id: [tuple(x) for x in r.repeats] for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [], 3: [(2, 30, 1), (33, 40, 2)], 4: []}


def test_ids_of_any_type(spark):
    run = " ".join(f"w{k}" for k in range(20))
    rows = [("b", run), ("a", run), (None, run), ("", "q")]
    got = {r.doc_id: r.n_removed for r in S.dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": 0, "b": 20, None: 20, "": 0}


def test_pieces_of_a_long_text_hash_alike(monkeypatch):
    from granary.llm import wordhash

    text = b" ".join(b"w%d" % (k * k) for k in range(3000)) + b"\n" + b"q" * 900 + b" end"
    whole = Hasher().words([text, b"", b"a b"])
    monkeypatch.setattr(wordhash, "PIECE", 97)
    cut = Hasher().words([text, b"", b"a b"])
    assert all(np.array_equal(x, y) for x, y in zip(whole[:4], cut[:4], strict=True))


def test_texts_lie_in_the_shared_folder(spark, tmp_path):
    from granary.llm.common import scratch_dir, text_bytes

    t = S.Texts(spark.createDataFrame([(1, "a")], "doc_id long, text string").select("doc_id", text_bytes().alias("text")))
    assert t.path.startswith(scratch_dir(spark)) and t.table.count() == 1
    t.drop()
