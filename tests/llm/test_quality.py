from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import quality_classifier as Q
from granary.llm import quality_rules as R
from granary.llm.common import Memo


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c, cover = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for k in range(len(w) - 2):
        if c[tuple(w[k : k + 3])] > 1:
            cover.update((k, k + 1, k + 2))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


TEXTS = ["", None, "a", "a a a a", "a b c a b c d", " \t\n\x0b\x0c\r", "x\n\nx\n y \nx", "#*$%&|<> é ü", "a b " * 3000, "one two three " + "one two three", "l\n" * 50]


def test_counts(spark, make_docs):
    got = R.add_counts(make_docs(TEXTS)).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in R.COUNTS) for r in got] == [counts(t) for t in TEXTS]


def test_counts_of_random_texts(spark, make_docs):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("abcd\n"), rng.integers(0, 60))) for _ in range(200)]
    got = R.add_counts(make_docs(texts)).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in R.COUNTS) for r in got] == [counts(t) for t in texts]


def test_limits_adapt_to_the_source(spark):
    # one source writes tables: what is normal there is not elsewhere
    prose = lambda k: " ".join(f"word{k}x{j}" for j in range(80))
    table = lambda k: " ".join(f"| cell{k}x{j}" for j in range(60))
    rows = [(k, prose(k), "en", "prose") for k in range(300)] + [(1000 + k, table(k), "en", "table") for k in range(300)]
    rows += [(5000, table(999), "en", "prose"), (5001, "", None, None), (5002, None, "en", "prose"), (5003, prose(3), None, None)]
    got = {r.doc_id: r for r in R.with_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[5000].kept and "high_symbols_per_word" in got[5000].failed
    assert all(got[k].kept for k in range(300)) and all(got[1000 + k].kept for k in range(300))
    assert got[5001].base_failed and got[5002].base_failed and not got[5001].kept and got[5003].kept


def test_limits_are_the_groups_quantiles(spark):
    """Against quantiles of all rows; the two sources differ by what their sketches learnt."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"{w}{j}" + "#" * int(rng.random() < share) for j, w in enumerate(rng.choice(["tree", "river", "hill", "walks"], 200))), "en", s) for k in range(1200) for s, share in [(("a", 0.02), ("b", 0.3))[k % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = R.add_counts(df.selectExpr("*", "lang as __lang", "source as __source")).persist()
    got = {r["__source"]: r.asDict() for r in R.limits(kept).collect()}
    true = kept.filter(~R.base_failed()).select("__source", *[c.alias(m) for m, c in R.measures().items()]).toPandas()
    for source, part in true.groupby("__source"):
        for m in R.MEASURES:
            ends = [part[m].quantile([max(0, p - 0.02), min(1, p + 0.02)]).tolist() for p in (0.5, R.TAIL)]  # the error of the sketch in rank
            if ends[1][1] == 0:  # nothing to learn a quantile from: no limit below what a short text resolves
                of = R.SHARES[m][1]
                short = kept.filter((F.col("__source") == source) & ~R.base_failed()).agg(F.percentile(F.greatest(F.col(of), F.lit(1)), 1 - R.TAIL)).first()[0]
                assert got[source][f"hi_{m}"] == pytest.approx(R.EVENTS * R.SHARES[m][2] / short, rel=0.05)
                continue
            low, high = ends[1][0] + 6 * (ends[1][0] - ends[0][1]), ends[1][1] + 6 * (ends[1][1] - ends[0][0])
            assert low - 1e-9 <= got[source][f"hi_{m}"] <= high + 1e-9
    assert got["b"]["hi_symbols_per_word"] > 3 * got["a"]["hi_symbols_per_word"]
    kept.unpersist()


def test_limits_on_documents(spark):
    """No group's limit of a share is 0, limits differ between groups, good documents stay and bad ones go."""
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("*", "lang as __lang", "source as __source")
    lim = R.limits(R.add_counts(docs)).collect()
    assert len(lim) > 10 and all(r.hi_word_length > 5 > r.lo_word_length > 0 for r in lim)
    for m in R.SHARES:
        assert sum(r[f"hi_{m}"] <= 0 for r in lim) == 0
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = {r.doc_id: r.kept for r in R.op6_quality_rules(spark, d).filter("not base_failed").collect()}
    good, bad = ([got[i] for i in got if labels.get(i) == y] for y in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def symbol_texts(share, n, words=300, seed=0):
    """Texts whose words carry a symbol with the given probability."""
    rng = np.random.default_rng(seed)
    return [" ".join(f"word{j}x{k}" + "%" * int(rng.random() < share) for j in range(words)) for k in range(n)]


def test_rare_symbols_of_long_texts_are_no_fault(spark):
    """Most texts have no symbol; a few are full of them, a few long ones have some: the limit parts the two."""
    rows = symbol_texts(0, 600) + symbol_texts(0.4, 25, seed=1)
    rows += [" ".join(f"word{j}x{k}" + "%" * int(j % 2000 == 7) for j in range(8000)) for k in range(10)]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in R.with_verdicts(df).collect()}
    assert all(got[i].kept for i in range(600)) and not any(got[600 + i].kept for i in range(25)) and all(got[625 + i].kept for i in range(10))


def test_equal_shares_get_equal_verdicts(spark):
    """Short and long texts of one source with the same share of symbols."""
    rows = symbol_texts(0, 400, words=100) + symbol_texts(0, 100, words=2000)
    odd = [" ".join(f"word{j}x{k}" + "%" * int(j % every == 0) for j in range(n)) for every in (2, 5, 50, 100) for k, n in enumerate((100, 1000, 10_000))]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(rows + odd)], "doc_id long, text string, lang string, source string")
    kept = [r.kept for r in sorted(R.with_verdicts(df).collect(), key=lambda r: r.doc_id)][500:]
    for a in range(0, 12, 3):
        assert len(set(kept[a : a + 3])) == 1
    assert kept[0] is False and kept[-1] is True


def test_one_population_of_symbols_stays(spark):
    """Where the texts that have symbols spread without a gap, there is nothing to part."""
    rng = np.random.default_rng(3)
    rows = symbol_texts(0, 500) + [t for k in range(60) for t in symbol_texts(float(np.exp(rng.uniform(np.log(0.004), np.log(0.06)))), 1, seed=k)]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string")
    assert R.with_verdicts(df).filter("not kept").count() <= 3


def test_repeated_rows_and_a_hot_source(spark, make_docs, monkeypatch):
    from granary.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "HOT_KEYS", 1 << 40)
    docs = make_docs([" ".join(f"w{j}" for j in range(60))] * 4 + ["w " * 100_000], [1, 1, 1, 2, 3])
    got = sorted((r.doc_id, r.kept, r.n_words) for r in R.with_verdicts(docs).collect())
    assert got == [(1, True, 60)] * 3 + [(2, True, 60), (3, False, 100_000)]


def test_rules_on_empty_table_and_clashing_columns(spark, make_docs):
    docs = make_docs(["a b c"] * 3).selectExpr("*", "'x' as n_words", "1 as kept", "2 as failed")
    got = R.with_verdicts(docs).collect()
    assert [r.n_words for r in got] == [3] * 3 and not any(r.kept for r in got)
    assert R.with_verdicts(docs.limit(0)).count() == 0


def test_native_plan(spark, make_docs):
    plan = R.add_counts(make_docs(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    model = {"b": 0.3, "w": rng.normal(size=Q.BUCKETS), "v": rng.normal(size=(Q.BUCKETS, Q.RANK))}
    slots, x = np.array([3, 9, 77, 1000]), rng.normal(size=4)
    z = Q.forward(model, np.zeros(4, int), slots, x, 1)[0][0]
    pairs = sum(model["v"][slots[i]] @ model["v"][slots[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert z == pytest.approx(0.3 + model["w"][slots] @ x + pairs)


def test_features_have_statistics_for_any_text():
    row, slot, x = Q.features([b"", b"a a b", b"\n\n"], Memo(Q.word_bucket))
    assert np.bincount(row).tolist() == [Q.STATS, Q.STATS + 2, Q.STATS] and np.isfinite(x).all() and slot.max() < Q.BUCKETS


def labelled(spark, n=120):
    rng = np.random.default_rng(2)
    good = lambda: " ".join(rng.choice(["tree", "river", "walks", "slowly", "over", "hills"], 40))
    texts = [(k, good() if k % 2 else " ".join(w + "&&&" for w in good().split())) for k in range(n)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(n)], "doc_id long, quality int")
    return docs, labels


def test_classifier_learns_and_leaves_held_out_rows_alone(spark):
    from pyspark.sql import functions as F

    from granary.llm.common import held_out

    docs, labels = labelled(spark)
    model = Q.train(docs, labels)
    got = Q.score_documents(docs, model).collect()
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got)
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = Q.train(docs, flipped)
    assert again["b"] == model["b"] and (again["w"] == model["w"]).all()


def test_classifier_edges(spark, make_docs):
    docs, labels = labelled(spark, 30)
    model = Q.train(docs, labels.limit(0))
    odd = make_docs(["", None, "w " * 50_000, "x"], [None, 1, 1, 2]).selectExpr("*", "'s' as score")
    assert [round(r.score, 3) for r in Q.score_documents(odd, model).collect()] == [0.5] * 4 or all(0 < r.score < 1 for r in Q.score_documents(odd, model).collect())
    assert Q.score_documents(odd.limit(0), model).count() == 0
    assert Q.train(docs.limit(0), labels)["b"] == 0


def test_quality_query_accuracy(spark):
    import os

    import pandas as pd

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    got = Q.op5_quality_classifier(spark, d).toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"))
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
