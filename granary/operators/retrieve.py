"""Retrieval as one operator: wordings of a question -> dense and sparse lists -> one shortlist -> pair scores -> gate.

The lists of all wordings are fused and merged before anything is scored, so each (query, document) pair of the
shortlist reaches the scorer once, however many lists hold it, and always with the question's own wording.
Pairs are dealt to tasks by both ids (neither a document in every list nor a question burdens one task), and within a task by
length, so that a scorer's batch holds texts of like size and at most ``PAIRS`` pairs or about ``CHARS`` characters; a
longer text is a batch of its own.

Questions: query_id, variant (0 is the question itself), text, embedding; a further wording, such as a transliteration, can add
candidates but removes none that the question finds by itself, up to the length of the list. A wording without a text has no sparse list, one
without a vector no dense one. A question that finds nothing keeps its row and abstains. Ties by doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sigmoid
from .graph import held
from .retrieval import SHORTLIST, coverage_gate, dense_topk, merge_variants, rrf_fuse, sparse_search, topk

PairScorer = Callable[[list[str], list[str]], np.ndarray]
PAIRS, CHARS = 32, 64_000


def lexical_scorer(questions: list[str], texts: list[str]) -> np.ndarray:
    """Offline stand-in for a cross-encoder's logits: the share of the question's distinct words in the text, stretched."""
    import re

    words = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    asked = [words(q) for q in questions]
    return np.array([8 * len(q & words(t)) / max(1, len(q)) - 4 for q, t in zip(asked, texts, strict=True)], float)


def candidates(questions: DataFrame, texts: DataFrame, vectors: DataFrame, top: int = SHORTLIST) -> DataFrame:
    """(query_id, doc_id, score, rank): the fused list of each wording, merged into one of ``top`` rows a query."""
    named = questions.select(F.concat_ws("/", F.col("query_id").cast("string"), "variant").alias("query_id"), F.col("query_id").alias("asked_id"), "variant", "text", "embedding")
    dense = dense_topk(vectors, named.filter("embedding is not null"))
    sparse = sparse_search(texts, named.filter("text is not null").select("query_id", "text"))
    lists = rrf_fuse(dense, sparse, top).join(named.select("query_id", "asked_id", "variant"), "query_id")
    return merge_variants(lists.select(F.col("asked_id").alias("query_id"), "variant", "doc_id", "rank"), top).select("query_id", "doc_id", F.col("score").alias("fused"), F.col("rank").alias("fused_rank"))


def in_batches(scorer: PairScorer, pairs: int = PAIRS, chars: int = CHARS):
    """Function of Arrow batches (query_id, doc_id, query_text, text) -> (query_id, doc_id, logit), scored in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked, texts = b.column("query_text").to_pylist(), b.column("text").to_pylist()
            logits, at = np.zeros(len(texts)), 0
            while at < len(texts):
                end, size = at + 1, len(texts[at] or "")
                while end < len(texts) and end - at < pairs and size + len(texts[end] or "") <= chars:
                    size += len(texts[end] or "")
                    end += 1
                logits[at:end] = scorer(asked[at:end], texts[at:end])
                at = end
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("doc_id"), pa.array(logits)], names=["query_id", "doc_id", "logit"])

    return run


def scored(pairs: DataFrame, scorer: PairScorer = lexical_scorer) -> DataFrame:
    """pairs: query_id, doc_id, query_text, text -> query_id, doc_id, score, the sigmoid of the scorer's logit."""
    kind = lambda c: pairs.schema[c].dataType.simpleString()
    dealt = pairs.select("query_id", "doc_id", "query_text", "text").repartition("query_id", "doc_id").sortWithinPartitions(F.length("text"))
    out = dealt.mapInArrow(in_batches(scorer), f"query_id {kind('query_id')}, doc_id {kind('doc_id')}, logit double")
    return out.select("query_id", "doc_id", F.round(sigmoid(F.col("logit")), 6).alias("score"))


def retrieve(questions: DataFrame, texts: DataFrame, vectors: DataFrame, thresholds: DataFrame | None = None, key: str = "source_type", scorer: PairScorer = lexical_scorer, top: int = SHORTLIST) -> DataFrame:
    """(query_id, action, top_score, doc_id, score, rank, fused, fused_rank): the reranked list under the gate's decision.

    texts: doc_id, text and the column ``key``, by which the thresholds are chosen; vectors: doc_id, embedding.
    """
    own = questions.filter("variant = 0").select("query_id", F.col("text").alias("query_text"))
    short = held(candidates(questions, texts.select("doc_id", "text"), vectors, top))
    pairs = short.join(texts.select("doc_id", "text"), "doc_id").join(own, "query_id")
    ranked = topk(held(scored(pairs, scorer)), top).join(texts.select("doc_id", key), "doc_id")
    gate = coverage_gate(own, ranked, thresholds, key)
    rows = ranked.drop(key).join(short, ["query_id", "doc_id"])
    return gate.select("query_id", "action", "top_score").join(rows, "query_id", "left")
