"""Corpus pipeline: five stages of the training-data operators over ``documents``.

quality classifier -> near-dedup -> benchmark decontamination -> PII -> SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each but the last returns the columns
of ``documents``. Documents that the classifier scores below 0.5 go; of each group of near copies (five-word
shingles, Jaccard similarity 0.8 or more) one stays; documents that leak a benchmark item go; personal data is replaced by its kind in angle
brackets (n_chars follows the new text); what is left is encoded, SAMPLES segmentations sampled without
replacement for each document, and decoded again as a check: the columns of a row are those of the best sample, ``samples`` has all of
them in order, and ``round_trip`` says that all were decoded to the text.

No SQL expresses the stages, so there is no oracle; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate, near_copies, pii, quality_classifier, sentencepiece_sampling
from granary.llm.common import free_name, materialize, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.train(docs, read_table(spark, sf_dir, "labels"))
    score = free_name(docs, "__score")
    return quality_classifier.score_documents(docs, model, out=score).filter(F.col(score) >= 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans, text = free_name(docs, "__spans"), free_name(docs, "__redacted")
    found = pii.find_pii(docs, redacted=text, out=spans)
    changed = {"text": F.col(text), "n_chars": F.when(F.size(spans) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    return found.withColumns(changed).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocab = sentencepiece_sampling.vocabulary()
    samples = free_name(docs, "__samples")
    found = sentencepiece_sampling.sample_segmentations(docs, vocab, ["doc_id"], ids=True, out=samples)
    s = F.col(samples)[0]
    best = [s.getField(c).alias(c) for c in ("n_pieces", "log_prob", "inclusion", "ids_hash", "ids")]
    return found.select("doc_id", "lang", "source", *best, F.forall(samples, lambda x: x["round_trip"]).alias("round_trip"), F.col(samples).alias("samples"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("encode", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
