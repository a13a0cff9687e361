from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest

from granary.llm import toxicity as T

WORDS = Counter({"idiot": 40, "stupid": 40, "loser": 40, "the": 900, "that": 400, "is": 500, "river": 50, "small": 60, "letter": 50, "pathetic": 30, "trash": 30, "stop": 30, "rate": 30, "and": 700, "it": 300, "lost": 30, "list": 30})


@pytest.fixture(scope="module")
def table():
    return T.CharModel(T.count_trigrams(WORDS)).table()


def test_trigram_counts():
    words = Counter({"ab": 2, "é": 3, "a1": 1})
    want = np.zeros(T.SYMBOLS**3, np.int64)
    for w, n in words.items():
        s = [0, 0, *[T.CODE.get(c, T.OTHER) for c in w], 0]
        for k in range(2, len(s)):
            want[(s[k - 2] * T.SYMBOLS + s[k - 1]) * T.SYMBOLS + s[k]] += n
    assert (T.count_trigrams(words) == want).all() and T.count_trigrams(Counter()).sum() == 0


@pytest.mark.parametrize(
    "given, want",
    [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiiiiot", "idiot"), ("st00pid", "stopid"), ("$tupid", "stupid"), ("stup1d!!", "stupid"), ("p@th3tic", "pathetic"), ("tr-a-sh", "trash"), ("letter", "letter"), ("2024", "2024"), ("", ""), ("l0$er", "loser"), ("лоser", None)],
)
def test_restore(table, given, want):
    got = T.restore_token(given, table)
    if given == "st00pid":
        assert got in ("stopid", "stoopid")
    elif want is not None:
        assert got == want


def test_spacing_is_joined(table):
    assert T.restore("you are an i d i o t and a l o s e r", table) == "you are an idiot and a loser" or "idiot" in T.restore("that i d i o t is", table).split()
    assert T.spaced_runs("a b".split()) == [] and T.spaced_runs("1 2 3".split()) == [] and T.spaced_runs("x a b c yy".split()) == ["x a b c"]


def test_viterbi_equals_search_over_all_paths(table):
    import itertools

    def best(chars):
        top = None
        for path in itertools.product(*T.options(chars)):
            a = b = 0
            s, said = 0.0, ""
            for x, cost in path:
                s += cost
                if x == "" or (x == "\0" and b == 0):
                    continue
                k = 0 if x == "\0" else T.CODE.get(x, T.OTHER)
                s += table[a][b][k]
                a, b = (0, 0) if k == 0 else (b, k)
                said += " " if x == "\0" else x
            s += table[a][b][0]
            top = max(top or (s, said), (s, said))
        return top[1].strip()

    for t in ("1d10t", "s-t.o", "aab", "l 0 s", "x$y"):
        assert T.viterbi(t, table) == best(t)


def data(spark, n=90):
    rng = np.random.default_rng(3)
    base = ["the", "that", "is", "river", "small", "letter", "rate", "and"]
    rows, labels = [], []
    for k in range(n):
        words = list(rng.choice(base, 30))
        if k % 3 == 0:
            words[3] = "idiot" if k % 2 else "stupid"
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_obfuscated_words_score_like_plain_ones(spark):
    docs, labels = data(spark)
    model = T.learn(docs, labels)
    odd = spark.createDataFrame([(1, "that 1d10t is small"), (2, "that i d i o t is"), (3, "that river is small"), (4, None), (5, ""), (None, "stuuupid " * 3), (7, "word " * 60_000)], "doc_id long, text string").selectExpr("*", "9 as score")
    got = {r.doc_id: r for r in T.score_documents(odd, model, restored="plain").collect()}
    assert got[1].score > 0.7 and got[2].score > 0.7 and got[None].score > 0.7
    assert max(got[k].score for k in (3, 4, 5, 7)) < 0.5
    assert got[1].plain == "that idiot is small" and got[4].plain is None


def test_edges(spark):
    docs, labels = data(spark, 12)
    model = T.learn(docs, labels.limit(0))
    assert [round(r.score, 6) for r in T.score_documents(docs, model).collect()] == [0.1] * 12
    assert T.score_documents(docs.limit(0), model).count() == 0
    assert T.learn(docs.limit(0), labels)["lexicon"] == {}


def test_held_out_accuracy(spark):
    import pandas as pd

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    got = T.op1_toxicity(spark, d).toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"))
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.93 and held[held.toxic == 0].predicted.mean() < 0.03


def test_digits_that_are_digits_stay():
    words = WORDS + Counter({"covid19": 30, "b12": 30, "mp3": 40, "2024": 50, "shit": 30, "route66": 20})
    table = T.CharModel(T.count_trigrams(words)).table()
    assert [T.restore_token(t, table) for t in ("covid19", "b12", "mp3", "2024", "455", "route66")] == ["covid19", "b12", "mp3", "2024", "455", "route66"]
    assert T.restore_token("1d10t", table) == "idiot" and T.restore_token("$#!7", table) == "shit" and T.restore_token("($#!7)", table) == "shit"


def test_every_sure_feature_is_kept(spark):
    words = [f"{chr(97 + w // 400 % 20)}k{chr(97 + w // 20 % 20)}m{chr(97 + w % 20)}z" for w in range(6000)]
    docs = spark.createDataFrame([(k, (" ".join(words) if k % 2 else "calm river") + f" {k}") for k in range(60)], "doc_id long, text string")
    model = T.learn(docs, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int"))
    assert {T.squeeze(w) for w in words} <= set(model["lexicon"]) and len(words) > 5000
