from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from granary.providers import encode, generate, hashed_encoder
from granary.streaming.requests import answer_stream


def test_stream_answers_each_key_once(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",), ("a",)], "key string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string").parquet(str(tmp_path / "in"))
    answer_stream(stream, lambda d: d.withColumn("answer", F.upper("key")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("key", "answer").collect()
    assert sorted(map(tuple, got)) == [("a", "A"), ("b", "B")]


def test_encoder_gets_texts_as_they_are(spark):
    seen = spark.createDataFrame([(1, " Query: x "), (2, None)], "id long, text string")

    def lengths(texts):
        return np.array([[len(t or "")] for t in texts], np.float32)

    assert [r.embedding for r in encode(seen, "id", "text", lengths).orderBy("id").collect()] == [[10.0], [0.0]]
    v = hashed_encoder(16)(["a b", ""])
    assert v.shape == (2, 16) and abs(np.linalg.norm(v[0]) - 1) < 1e-6 and not v[1].any()


def test_generator_falls_back_to_a_quote(spark):
    rows = spark.createDataFrame([(1, "q", ["first", "second"]), (2, "q", None)], "query_id long, question string, sources array<string>")

    def broken(question, sources):
        raise RuntimeError("no model")

    assert {r.query_id: r.answer for r in generate(rows, broken).collect()} == {1: "first [S1]", 2: ""}
