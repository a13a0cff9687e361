"""Persistent index of token counts in blocks: exact sparse top-k that leaves out blocks which can't matter.

Building tokenises each text once. Documents are dealt into blocks of about ``BLOCK`` of nearly equal length, so
that blocks of short documents have low maxima. One table is published: ``postings`` (block, doc_id, words, tfs), the
distinct tokens of a document and how often it has them; blocks are dealt to files by hash, long documents first in each.

A search never tokenises documents. It goes through the blocks as ``sparse.products`` does: for each query and
block the sum of query tf x maximum bounds any score in the block, and only queries whose bound reaches their k-th best
score so far are scored there. The result equals that of scoring all postings, ties included. A frequent token is
spread over all blocks; nothing is joined on it, and no pair of query and block is written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import alnum_words
from ..sources import snapshot
from . import sparse
from .retrieval import SPARSE_TOP

BLOCK, CHARS = 64, 1 << 22  # documents and, for very long ones, about so many characters in a block


def dealt(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, text, block): the length's class (eight to a doubling), and within it a hash into parts of about ``block`` documents."""
    rows = texts.withColumn("class", F.floor(8 * F.log2(F.length("text") + F.lit(1.0))).cast("int"))
    parts = rows.groupBy("class").agg(F.ceil(F.greatest(F.count("*") / block, F.sum(F.length("text")) / CHARS)).alias("parts"))  # some 8 x 31 rows at most
    rows = rows.join(F.broadcast(parts), "class")
    return rows.select("doc_id", "text", (F.col("class").cast("long") * (1 << 40) + F.pmod(F.xxhash64("doc_id"), F.col("parts"))).alias("block"))


def counted(batches):
    """Arrow batches (block, doc_id, words) with the distinct words of each row, and how often it has them."""
    for b in batches:
        words = b.column("words")
        n = pc.list_value_length(words).fill_null(0).to_numpy().astype(np.int64)
        flat = words.flatten().dictionary_encode()
        many = max(1, len(flat.dictionary))
        cell, tf = np.unique(np.repeat(np.arange(len(n)), n) * many + flat.indices.to_numpy(), return_counts=True)
        at = pa.array(np.r_[0, np.cumsum(np.bincount(cell // many, minlength=len(n)))].astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, flat.dictionary.take(pa.array(cell % many))), pa.ListArray.from_arrays(at, pa.array(tf.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([b.column("block"), b.column("doc_id"), *lists], names=["block", "doc_id", "words", "tfs"])


def build(texts: DataFrame, folder: str, block: int = BLOCK) -> snapshot.Manifest:
    """Publish the index of texts (doc_id, text); null texts have no postings. Rows that share an id are one document."""
    rows = dealt(sparse.merged(texts), block).select("block", "doc_id", alnum_words(F.col("text")).alias("words"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    postings = rows.mapInArrow(counted, f"block long, doc_id {kind}, words array<string>, tfs array<int>")
    return snapshot.write({"postings": postings.repartition("block").sortWithinPartitions(F.desc("block"))}, folder)


def search(spark: SparkSession, folder: str, asked: DataFrame, k: int = SPARSE_TOP) -> tuple[DataFrame, DataFrame]:
    """The k best documents of each query as ``sparse_topk`` gives them, and (query_id, blocks, scored).

    asked: query_id, token, tf.
    """
    named = sparse.vectors(asked)
    found = sparse.products(snapshot.read(spark, folder)["postings"], named, k)
    work = found.filter("doc_id is null").groupBy("first").agg(F.sum("blocks").alias("blocks"), F.sum("scored").alias("scored")).filter("blocks > 0")
    return sparse.best_of(found, named, k), named.select("query_id", "first").join(work, "first").drop("first")
