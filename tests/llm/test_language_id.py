from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import language_id as M
from granary.llm.common import read_table

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "ña"], "bb": ["sch", "ver", "ung", "keit", "ä"], "cc": ["th", "ing", "wh", "re", "on"]}


def words(lang: str, n: int, rng: random.Random) -> str:
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(4)
    rows = [(k, words(lang, rng.randint(3, 80), rng), lang) for k, lang in enumerate(list(SYLLABLES) * 150)]
    return M.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 300)


def plain(net: M.Network, text: bytes) -> np.ndarray:
    """Convolution, rectifier, maximum and softmax written out, over the windows of a text."""
    total, weight = 0, 0
    width = np.repeat(M.WIDTHS, M.FILTERS)
    at = 0
    while True:
        piece = text[at : at + M.WINDOW]
        x = net.embed[np.frombuffer(piece.ljust(M.WINDOW, b"\0"), np.uint8)].astype(float)
        top = [max(sum(float(x[i + k] @ net.filters[k][:, f]) for k in range(width[f])) for i in range(M.STRIDE)) + net.bias[f] for f in range(len(width))]
        z = np.maximum(top, 0) @ net.out + net.out_bias
        p = np.exp(z - z.max())
        total, weight = total + max(1, len(piece)) * p / p.sum(), weight + max(1, len(piece))
        if at + M.WINDOW >= len(text):
            return total / weight
        at += M.STRIDE


def test_tables_equal_plain_convolution(net):
    rng = random.Random(1)
    texts = [words("aa", n, rng).encode() for n in (1, 5, 60, 200)] + [b"x" * 256, b"y" * 257, b"z" * 508, b""]
    got = M.probabilities_of(texts, net, net.tables())
    for t, p in zip(texts, got, strict=True):
        assert np.allclose(plain(net, t), p, atol=1e-4)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 507, 508, 509, 5000])
def test_windows_cover_every_run_of_bytes(n):
    w = [(a, min(n, a + M.WINDOW)) for a in M.starts(n)]
    for i in range(max(0, n - max(M.WIDTHS) + 1)):
        assert any(a <= i and i + max(M.WIDTHS) <= e for a, e in w)
    assert w[-1][1] == n and all(e < n for _, e in w[:-1])


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = M.Network(["a", "b", "c"])
    for p in net.parameters():
        setattr(net, p, getattr(net, p).astype(np.float64))
    net.used = net.used.astype(np.float64)
    w, y = rng.integers(0, 256, (4, M.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        return -np.log(net.probabilities(net.pooled(w, net.tables())[0])[np.arange(4), y]).mean()

    for p, g in zip(net.parameters(), net.gradients(w, y), strict=True):
        a = getattr(net, p)
        for i in rng.choice(a.size, min(6, a.size), replace=False):
            at = np.unravel_index(i, a.shape)
            old, eps = a[at], 1e-6
            a[at] = old + eps
            up = loss()
            a[at] = old - eps
            down = loss()
            a[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 1e-4, p


def test_accuracy_on_unseen_texts(net, spark):
    rng = random.Random(9)
    rows = [(k, words(lang, rng.randint(3, 40), rng), lang) for k, lang in enumerate(list(SYLLABLES) * 60)]
    out = M.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), net)
    assert out.filter("lang = lang_pred").count() >= 0.97 * len(rows)


def test_query_on_held_out_documents(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    out = M.op13_language_id(spark, sf).toPandas()
    docs = read_table(spark, sf, "documents").select("doc_id", "lang").toPandas()
    assert len(out) == len(docs) and set(out.columns) == {"doc_id", "held_out", "lang_pred", "score"}
    both = out.merge(docs, on="doc_id")
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in both.doc_id]).all()
    assert (both.lang == both.lang_pred)[both.held_out].mean() >= 0.95 and both.score.between(0, 1).all()


def test_labels_of_held_out_rows_do_not_matter(spark):
    rng = random.Random(2)
    rows = [(k, words(lang, 10, rng), lang) for k, lang in enumerate(list(SYLLABLES) * 30)]
    kind = "doc_id long, text string, lang string"
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, t, x in rows]
    a, b = (M.train(spark.createDataFrame(r, kind), 60) for r in (rows, other))
    assert a.languages == b.languages and all((getattr(a, p) == getattr(b, p)).all() for p in a.parameters())


def test_edges(net, spark):
    rows = [(1, None, None), (2, "", "aa"), (3, "123 -- \n", "aa"), (None, "kalomi", None), (5, "kalomi", "aa"), (5, "kalomi", "aa"), (6, "vermiung " * 100_000, "bb"), (7, "日本", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("old"), "__letter": F.lit(1), "b": F.lit(2)})
    got = M.identify(df, net).collect()
    assert len(got) == len(rows) and got[0].__fields__.count("score") == 1 and "__letter" in got[0].__fields__
    by = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in got}
    assert by[1, None] == by[2, ""] == by[3, "123 -- \n"] == ("und", 0.0)
    assert all(p in net.languages and 0 < s <= 1 for (i, t), (p, s) in by.items() if t and i != 3)
    none = spark.createDataFrame([(1, "kalo", None), (2, None, "aa"), (3, "12", "aa")], "doc_id long, text string, lang string")
    assert M.train(none) is None and {r.lang_pred for r in M.identify(none, None).collect()} == {"und"}
    empty = none.limit(0)
    assert M.train(empty) is None and M.identify(empty, net).count() == 0
