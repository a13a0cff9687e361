"""Hybrid retrieval: exact dense and sparse top-k, rank fusion, rerank, gate, presentation.

Frames are keyed by query_id, so a batch of queries is one plan. The query side of a scan is
broadcast: it is a stated query set, taken in blocks of about ``MOST_QUERIES`` rows, scored against all rows.
Top-k uses row_number() <= k, which Spark plans as a group limit before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import alnum_plain, alnum_words, sigmoid
from . import sparse
from .graph import held

RRF_K, DENSE_TOP, SPARSE_TOP, SHORTLIST, CONTEXT = 60, 30, 30, 12, 6
DOMINANCE = 0.15
MOST_QUERIES, QUERY_CHUNK = 10_000, 256
MOST_IDS = 200_000  # so many keys at most are sent to every task
DEFAULT_THRESHOLDS = (0.15, 0.35)


def topk(scored: DataFrame, k: int, by: str = "score", key: str = "doc_id", rank: str = "rank") -> DataFrame:
    """The k best rows of each query, ranks from 1; ties by key."""
    w = W.partitionBy("query_id").orderBy(F.desc(by), F.asc(key))
    return scored.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def best_of_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties by the smaller id; ``ids`` ascend."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, -k)[-k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def usable(e: Column, size: int) -> Column:
    finite = F.forall(e, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return (F.size(e) == size) & finite & F.exists(e, lambda x: x != 0)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = DENSE_TOP, keep: Column | None = None) -> DataFrame:
    """Exact cosine top-k, scores rounded to six places, ties by doc_id. vectors: doc_id, embedding; queries: query_id, embedding; ``keep`` filters before scoring.

    Queries are unit vectors in blocks of at most about MOST_QUERIES; a block is multiplied with Arrow
    batches of vectors, and a task keeps k rows a query while it reads, so it sends k rows a query whatever it
    holds. A vector that is null, zero, not finite or of another length than the queries has no score.
    """
    v = (vectors if keep is None else vectors.filter(keep)).select("doc_id", "embedding")
    q = queries.select("query_id", "embedding").filter(F.size("embedding") > 0)
    sizes = q.agg(F.count("*").alias("n"), F.mode(F.size("embedding")).alias("size")).first()
    size, blocks = sizes["size"] or 0, -(-max(1, sizes["n"]) // MOST_QUERIES)
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, doc_id {v.schema['doc_id'].dataType.simpleString()}, score double"
    out = None
    for b in range(blocks):
        part = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        asked = part.filter(usable(F.col("embedding"), size)).toArrow()
        scored = v.filter(usable(F.col("embedding"), size)).mapInArrow(block_products(asked, max(1, size), k), schema)
        found = topk(scored, k).select("query_id", "doc_id", "score", "rank")
        out = found if out is None else out.unionByName(found)
    return out


def unit_rows(column, size: int) -> np.ndarray:
    """Rows of an Arrow column of lists as unit vectors."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    m /= np.abs(m).max(1, keepdims=True, initial=1e-300)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def block_products(asked: pa.Table, size: int, k: int):
    """Function of Arrow batches (doc_id, embedding) -> the k best rows of a task for each query."""

    def run(batches):
        table = asked.combine_chunks()
        ids = table.column("query_id")
        q = np.concatenate([unit_rows(c, size) for c in table.column("embedding").chunks] or [np.zeros((0, size))])
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        for b in batches:
            docs = b.column("doc_id").to_numpy(zero_copy_only=False)
            order = np.argsort(docs, kind="stable")
            docs, v = docs[order], unit_rows(b.column("embedding"), size)[order]
            for at in range(0, len(q), QUERY_CHUNK):
                products = np.round(q[at : at + QUERY_CHUNK] @ v.T, 6)
                for j, row in enumerate(products, at):
                    best = best_of_rows(row, docs, k)
                    known, scores = held[j]
                    known, scores = np.concatenate([known, docs[best]]), np.concatenate([scores, row[best]])
                    order = np.argsort(known, kind="stable")
                    best = best_of_rows(scores[order], known[order], k)
                    held[j] = known[order][best], scores[order][best]
        n = [len(d) for d, _ in held]
        if sum(n):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(q)), n))).combine_chunks(), pa.array(np.concatenate([d for d, _ in held])), pa.array(np.concatenate([s for _, s in held]))], names=["query_id", "doc_id", "score"])

    return run


def postings(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token, tf); token counts are summed before the shuffle."""
    return texts.select(key, F.explode(alnum_words(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def sparse_topk(doc_postings: DataFrame, query_postings: DataFrame, k: int = SPARSE_TOP) -> DataFrame:
    """Sparse dot product top-k: an equi-join of postings on the token."""
    q = query_postings.select("query_id", "token", F.col("tf").alias("qtf"))
    scored = doc_postings.join(q, "token").groupBy("query_id", "doc_id").agg(F.sum(F.col("tf") * F.col("qtf")).cast("double").alias("score"))
    return topk(scored, k)


def sparse_search(texts: DataFrame, questions: DataFrame, k: int = SPARSE_TOP) -> DataFrame:
    """sparse_topk over texts (doc_id, text) and questions (query_id, text), in blocks of documents: no pair of query and document is written."""
    named = sparse.vectors(postings(questions, "query_id"))
    rows = sparse.merged(texts).select("doc_id", alnum_plain(F.col("text")).alias("plain"))
    return sparse.best_of(sparse.products(rows, named, k), named, k)


def rrf_fuse(dense: DataFrame, sparse: DataFrame, top: int = SHORTLIST) -> DataFrame:
    """Reciprocal rank fusion of two lists: a full outer join in which a missing side adds nothing."""
    part = lambda c: F.coalesce(F.lit(1.0) / (F.col(c) + RRF_K), F.lit(0.0))
    d, s = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank")), sparse.select("query_id", "doc_id", F.col("rank").alias("sparse_rank"))
    fused = d.join(s, ["query_id", "doc_id"], "full_outer").withColumn("score", F.round(part("dense_rank") + part("sparse_rank"), 9))
    return topk(fused, top)


def merge_variants(lists: DataFrame, top: int = SHORTLIST) -> DataFrame:
    """Fuse the lists of several wordings of a query; (query_id, variant, doc_id, rank)."""
    out = lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.lit(1.0) / (F.col("rank") + RRF_K)), 9).alias("score"), F.min("rank").alias("best_rank"))
    return topk(out, top)


def lexical_pair_score(query_text: Column, doc_text: Column) -> Column:
    """Offline stand-in for a cross-encoder's logit: share of the query's distinct words in the document, stretched."""
    q = F.array_distinct(alnum_words(query_text))
    return 8 * F.size(F.array_intersect(q, alnum_words(doc_text))) / F.greatest(F.size(q), F.lit(1)) - 4


def lexical_pairs(pairs: DataFrame, questions: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (query_id, doc_id) with the other columns of ``texts`` (doc_id, text, ...) and the logit of ``lexical_pair_score``.

    A text is split into words once, however many questions have found it, and meets their words by an equi-join; no text stands beside a pair.
    """
    pairs = held(pairs)
    ids = held(pairs.select("doc_id").distinct())
    # rows that share an id keep their own words
    found = texts.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "doc_id", "left_semi").withColumn("__mark", F.xxhash64("text"))
    tasks = 4 * pairs.sparkSession.sparkContext.defaultParallelism  # few long texts are not put into one task
    whole = found.select("doc_id", "__mark", "text").repartition(tasks, "__mark").dropDuplicates(["doc_id", "__mark"])
    there = whole.select("doc_id", "__mark", F.explode(F.array_distinct(alnum_words(F.col("text")))).alias("word"))
    words = held(questions.select("query_id", F.array_distinct(alnum_words(F.col("text"))).alias("words")))
    asked = pairs.join(words, "query_id").select("query_id", "doc_id", F.explode("words").alias("word"))
    shared = asked.join(there, ["doc_id", "word"]).groupBy("query_id", "doc_id", "__mark").agg(F.count("*").cast("int").alias("__n"))
    out = pairs.join(words.select("query_id", F.size("words").alias("__size")), "query_id").join(found.drop("text"), "doc_id").join(shared, ["query_id", "doc_id", "__mark"], "left")
    return out.withColumn("logit", 8 * F.coalesce("__n", F.lit(0)) / F.greatest("__size", F.lit(1)) - 4).drop("__n", "__size", "__mark")


def rerank(candidates: DataFrame, top: int = SHORTLIST, logit: Column | None = None) -> DataFrame:
    """candidates: query_id, doc_id, query_text, text; score is the sigmoid of the pair's logit."""
    x = lexical_pair_score(F.col("query_text"), F.col("text")) if logit is None else logit
    return topk(candidates.withColumn("score", F.round(sigmoid(x), 6)), top)


def with_thresholds(rows: DataFrame, thresholds: DataFrame | None, key: str) -> DataFrame:
    """Thresholds of the row's key, else of the key 'default', else constants."""
    hard, soft = DEFAULT_THRESHOLDS
    if thresholds is None:
        return rows.withColumns({"tau_hard": F.lit(hard), "tau_soft": F.lit(soft)})
    t = thresholds.select(F.col("source_type").alias(key), "tau_hard", "tau_soft")
    base = thresholds.filter("source_type = 'default'").agg(F.max("tau_hard").alias("__h"), F.max("tau_soft").alias("__s"))
    out = rows.join(F.broadcast(t), key, "left").join(F.broadcast(base), F.lit(True))
    return out.withColumns({"tau_hard": F.coalesce("tau_hard", "__h", F.lit(hard)), "tau_soft": F.coalesce("tau_soft", "__s", F.lit(soft))}).drop("__h", "__s")


def gate_action(score: Column, hard: Column, soft: Column) -> Column:
    return F.when(score < hard, "abstain").when(score < soft, "answer_low_confidence").otherwise("answer")


def coverage_gate(queries: DataFrame, reranked: DataFrame, thresholds: DataFrame | None = None, key: str = "source_type") -> DataFrame:
    """One row per query; a query without candidates scores 0 and abstains. The thresholds are those of the top row's key."""
    first = reranked.filter("rank = 1").select("query_id", F.col("score").alias("top_score"), key)
    out = with_thresholds(queries.select("query_id").join(first, "query_id", "left"), thresholds, key)
    out = out.withColumn("top_score", F.coalesce("top_score", F.lit(0.0)))
    return out.withColumn("action", gate_action(F.col("top_score"), F.col("tau_hard"), F.col("tau_soft"))).select("query_id", "top_score", "tau_hard", "tau_soft", "action")


def dominant(reranked: DataFrame, gate: DataFrame) -> DataFrame:
    """Whether the first candidate stands out: alone, or ahead by more than DOMINANCE, and the gate answers."""
    w = W.partitionBy("query_id").orderBy("rank")
    led = reranked.withColumn("next", F.lead("score").over(w)).filter("rank = 1").select("query_id", "score", "next")
    ahead = F.col("next").isNull() | (F.round(F.col("score") - F.col("next"), 6) > DOMINANCE)
    return gate.join(led, "query_id", "left").select("query_id", (F.coalesce(F.col("action") == "answer", F.lit(False)) & F.col("score").isNotNull() & ahead).alias("dominant"))


def document_order(reranked: DataFrame, page: str, path: str, most: int = CONTEXT) -> DataFrame:
    """The best row first, the others by page (null as 0) and path; tagged S1, S2, ..."""
    w = W.partitionBy("query_id").orderBy(F.when(F.col("rank") == 1, 0).otherwise(1), F.coalesce(F.col(page), F.lit(0)), F.coalesce(F.col(path), F.lit("")), "doc_id")
    return reranked.filter(F.col("rank") <= most).withColumn("position", F.row_number().over(w)).withColumn("tag", F.concat(F.lit("S"), "position"))


def suggestions(reranked: DataFrame, section: str, n: int = 3) -> DataFrame:
    """The first n distinct sections of each query's list, in order."""
    firsts = reranked.groupBy("query_id", section).agg(F.min("rank").alias("first"))
    w = W.partitionBy("query_id").orderBy("first", section)
    return firsts.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def ordered_distinct(rows: DataFrame, by: list[str], value: str, order: str, most: int | None = None, out: str = "items") -> DataFrame:
    """Distinct values of each group in the order of their first appearance, as one string."""
    firsts = rows.groupBy(*by, value).agg(F.min(order).alias("__o"))
    items = F.array_sort(F.collect_list(F.struct("__o", F.col(value).cast("string").alias("v"))))
    return firsts.groupBy(*by).agg(F.array_join(F.transform(items if most is None else F.slice(items, 1, most), lambda s: s.v), ",").alias(out))
