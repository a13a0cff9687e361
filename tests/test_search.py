"""Blocked dense products against plain cosines, and the pruned index against all postings."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import index as IX
from granary.operators import retrieval as R
from granary.operators import sparse as S


def plain_knn(rows, queries, k):
    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6)

    good = lambda e: e is not None and len(e) == 4 and all(x is not None and math.isfinite(x) for x in e) and any(e)
    out = {}
    for q, e in queries:
        if good(e):
            ranked = sorted((-cos(v, e), i) for i, v in rows if good(v))[:k]
            out |= {(q, i): (-s, r) for r, (s, i) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("most", [10_000, 7])
def test_dense_topk(spark, monkeypatch, most):
    monkeypatch.setattr(R, "MOST_QUERIES", most)
    monkeypatch.setattr(R, "QUERY_CHUNK", 3)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)]) for i in range(300)]  # few values: many ties
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(150)]  # a third of all rows are copies
    rows += [(2000, None), (2001, [0.0] * 4), (2002, [1.0, None, 1.0, 1.0]), (2003, [float("nan")] * 4), (2004, [1.0] * 3), (2005, [float("inf"), 1.0, 1.0, 1.0])]
    queries = [(q, [rng.uniform(-1, 1) for _ in range(4)]) for q in range(20)] + [(50, [1.0, 2.0, 3.0, 4.0]), (51, None), (52, [0.0] * 4)]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    got = {(r.query_id, r.doc_id): (r.score, r["rank"]) for r in R.dense_topk(v, q, 5).collect()}
    want = plain_knn(rows, queries, 5)
    assert got.keys() == want.keys() and all(abs(got[x][0] - want[x][0]) < 1e-9 and got[x][1] == want[x][1] for x in want)
    few = R.dense_topk(v, q, 5, keep=F.col("doc_id") < 3)
    assert few.groupBy("query_id").count().agg(F.max("count")).first()[0] == 3
    assert R.dense_topk(v.limit(0), q).count() == 0 and R.dense_topk(v, q.limit(0)).count() == 0


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocab, weights, k=int(rng.choice([5, 20, 60, 400]) * rng.uniform(0.5, 1.5))))) for i in range(900)]
    rows += [(2000 + i, rows[3][1]) for i in range(300)]  # copies of one text
    return spark.createDataFrame([*rows, (5000, None), (5001, ""), (5002, "Übung w1 w1")], "doc_id long, text string")


@pytest.mark.parametrize("k", [1, 5, 30])
def test_index_equals_all_postings_and_leaves_blocks_out(spark, texts, tmp_path, k):
    IX.build(texts, str(tmp_path / "ix"), block=16)
    asked = R.postings(spark.createDataFrame([(0, "w3 w50 w50"), (1, "w0"), (2, "w200 w7 w399"), (3, "unheard of"), (4, "ü w1"), (5, None)], "query_id long, text string"), "query_id")
    got, work = IX.search(spark, str(tmp_path / "ix"), asked, k)
    want = R.sparse_topk(R.postings(texts, "doc_id"), asked, k)
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert key(got) == key(want)
    w = work.agg(F.sum("blocks").alias("b"), F.sum("scored").alias("s")).first()
    assert w.s < 0.6 * w.b  # most blocks cannot hold one of the best


@pytest.mark.parametrize("ids", ["long", "string"])
def test_search_in_sets_equals_all_postings(spark, texts, monkeypatch, ids):
    monkeypatch.setattr(S, "MOST_VECTORS", 3)
    monkeypatch.setattr(S, "CELLS", 4)
    again = texts.filter("doc_id < 40").unionByName(texts.filter("doc_id between 20 and 60")).unionByName(texts.filter("doc_id > 60"))  # ids with two rows
    rows = again.withColumn("doc_id", F.col("doc_id").cast(ids))
    questions = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(["w3 w50 w50", "w0", "w50 w3 w50", "", "w1 w2", "W0!", "w399", "none of them", "w7 w8 w9 w10 w11"] * 3)], "query_id string, text string")
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert key(R.sparse_search(rows, questions, 7)) == key(R.sparse_topk(R.postings(rows, "doc_id"), R.postings(questions, "query_id"), 7))


def test_what_a_search_sends_grows_with_distinct_questions_alone(spark, texts, tmp_path):
    IX.build(texts, str(tmp_path / "ix"))
    questions = spark.range(2000).select(F.col("id").alias("query_id"), F.concat(F.lit("w0 w"), F.col("id") % 5).alias("text"))
    named = S.vectors(R.postings(questions, "query_id"))
    found = S.products(IX.snapshot.read(spark, str(tmp_path / "ix"))["postings"], named, 3)
    assert found.count() <= 5 * 4 * found.rdd.getNumPartitions()
    assert IX.search(spark, str(tmp_path / "ix"), R.postings(questions, "query_id"), 3)[0].count() == 6000


def test_empty_index(spark, texts, tmp_path):
    IX.build(texts.limit(0), str(tmp_path / "ix"))
    asked = R.postings(spark.createDataFrame([(0, "w3")], "query_id long, text string"), "query_id")
    assert IX.search(spark, str(tmp_path / "ix"), asked)[0].count() == 0


def test_pairs_are_scored_by_words_that_are_split_once(spark):
    r = random.Random(3)
    word = lambda: r.choice(["Aid", "rate", "x1", "of", "é", "micro-unit", "", "20%"])
    texts = [(i, None if i == 4 else " ".join(word() for _ in range(r.randrange(30))), f"s{i}") for i in range(20)] + [(3, "again a rate", "t"), (3, "again a rate", "t"), (4, "aid", "u")]
    asked = [(f"q{k}", " ".join(word() for _ in range(r.randrange(6)))) for k in range(30)]
    pairs = spark.createDataFrame([(q, i) for q, _ in asked for i in r.sample(range(22), 5)], "query_id string, doc_id long")
    t, q = spark.createDataFrame(texts, "doc_id long, text string, source_type string"), spark.createDataFrame(asked, "query_id string, text string")
    plain = pairs.join(q.withColumnRenamed("text", "query_text"), "query_id").join(t, "doc_id").withColumn("logit", R.lexical_pair_score(F.col("query_text"), F.col("text")))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "source_type", "logit").collect()))
    got = R.lexical_pairs(pairs, q, t)
    assert "text" not in got.columns and rows(got) == rows(plain)


def test_few_words_at_a_time_give_the_same_rows(spark, monkeypatch):
    r = random.Random(11)
    texts = [(i, None if i % 50 == 7 else " ".join(f"w{min(r.randrange(40), r.randrange(40))}" for _ in range(r.randrange(1, 200) if i % 9 else 900))) for i in range(700)]
    asked = [(q, " ".join(f"w{r.randrange(45)}" for _ in range(r.randrange(1, 8)))) for q in range(60)]
    t, q = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    want = sorted(map(tuple, R.sparse_topk(R.postings(t, "doc_id"), R.postings(q, "query_id"), 5).collect()))
    named = S.vectors(R.postings(q, "query_id"))
    both = t.select("doc_id", R.alnum_words(F.col("text")).alias("words")).toArrow(), t.select("doc_id", R.alnum_plain(F.concat(F.lit("- "), "text", F.lit(" É."))).alias("plain")).toArrow()
    for words, rows in ((w, x) for w in (300, 1 << 20) for x in both):
        monkeypatch.setattr(S, "WORDS", words)
        seen = []
        monkeypatch.setattr(S.pc, "index_in", lambda x, plain=S.pc.index_in, **k: (seen.append(len(x)), plain(x, **k))[1])
        heads = named.filter("query_id = first").select(F.col("query_id").alias("first"), F.col("vector.token").alias("tokens"), F.col("vector.tf").alias("tfs")).toArrow()
        out = spark.createDataFrame([x for b in S.block_scores(heads, 5, 16)(rows.combine_chunks().to_batches()) for x in b.to_pylist()], "first long, doc_id long, score double, blocks long, scored long")
        monkeypatch.undo()
        got = sorted(map(tuple, S.best_of(out, named, 5).select("query_id", "doc_id", "score", "rank").collect()))
        assert got == want
        assert (max(seen) < 16 * 910 + 300 and len(seen) > 10) if words == 300 else len(seen) == 1  # a block at a time, or the whole batch
