"""A memo across micro-batches: mode in the key, expiry, tiers that are never kept, restarts and repeated batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from granary.streaming.memo import memo_stream, serve

ROW = "request_id long, text string, mode string, language string, asked_at timestamp"


@pytest.fixture
def desk(spark, tmp_path):
    """Requests that arrive in batches; each call runs the stream anew on the same checkpoint."""
    made = []

    def answer(d):
        rows = d.collect()
        made.append(sorted((r.mode, r.text or "") for r in rows))
        tier = F.when(F.col("text").contains("unknown"), "abstain").when(F.col("text") == "hello", "greeting").otherwise("synthesis")
        return d.select("key", F.concat_ws("/", "mode", "text", F.lit(str(len(made)))).alias("answer"), tier.alias("tier"))

    def ask(number, rows):
        where = str(tmp_path / "in")
        df = spark.createDataFrame([(i, t, m, "en", s) for i, t, m, s in rows], ROW.replace("timestamp", "long"))
        df.withColumn("asked_at", F.timestamp_seconds("asked_at")).coalesce(1).write.mode("append").parquet(where)
        stream = spark.readStream.schema(ROW).parquet(where)
        memo_stream(stream, answer, str(tmp_path / "out"), str(tmp_path / "check"), ttl=100).awaitTermination(120)
        got = spark.read.parquet(str(tmp_path / "out" / "answers")).filter(F.col("batch") == number).collect()
        return {r.request_id: (r.answer, r.from_memo) for r in got}

    return ask, made, str(tmp_path / "out"), answer


def test_three_batches_and_a_restart(spark, desk):
    ask, made, out, answer = desk
    assert ask(0, [(1, "Rate?", "rag", 1000), (2, " rate? ", "rag", 1001), (3, "unknown", "rag", 1001), (4, "hello", "rag", 1001), (5, None, "rag", 1001)]) == {
        1: ("rag/Rate?/1", False), 2: ("rag/Rate?/1", True), 3: ("rag/unknown/1", False), 4: ("rag/hello/1", False), 5: ("rag/1", False),
    }
    # another mode is another key; abstentions and greetings are answered again; each call restarts the stream
    assert ask(1, [(6, "rate?", "rag", 1050), (7, "rate?", "records", 1050), (8, "unknown", "rag", 1050), (9, "hello", "rag", 1050), (10, "unknown", "rag", 1050)]) == {
        6: ("rag/Rate?/1", True), 7: ("records/rate?/2", False), 8: ("rag/unknown/2", False), 9: ("rag/hello/2", False), 10: ("rag/unknown/2", False),
    }
    # the first answer expires 100 s after second 1001, the second one doesn't
    assert ask(2, [(11, "rate?", "rag", 1101), (12, "rate?", "records", 1101)]) == {11: ("rag/rate?/3", False), 12: ("records/rate?/2", True)}
    assert made[1:] == [[("rag", "hello"), ("rag", "unknown"), ("records", "rate?")], [("rag", "rate?")]]
    # folders go ttl seconds after they expired
    held = lambda: {r.until for r in spark.read.parquet(f"{out}/memo").select("until").distinct().collect()}
    assert held() == {1101, 1150, 1201}
    assert ask(3, [(13, "rate?", "rag", 1205)]) == {13: ("rag/rate?/4", False)} and held() == {1150, 1201, 1305}


def test_a_repeated_batch_leaves_no_duplicates(spark, desk):
    _, made, out, answer = desk
    rows = spark.createDataFrame([(1, "a", "rag", "en", 5), (1, "a", "rag", "en", 5), (2, "a", "rag", "en", None)], ROW.replace("timestamp", "long")).withColumn("asked_at", F.timestamp_seconds("asked_at"))
    for _ in range(2):
        serve(rows, 0, answer, out, 100)
        assert spark.read.parquet(f"{out}/answers").count() == 3 and spark.read.parquet(f"{out}/memo").count() == 1
    serve(rows.limit(0), 1, answer, out, 100)
    assert spark.read.parquet(f"{out}/answers").count() == 3
    serve(rows, 2, answer, out, 100)
    assert all(r.from_memo for r in spark.read.parquet(f"{out}/answers").filter("batch = 2").collect())
