"""Memo of a stream of requests: answers are kept by key across micro-batches, with expiry.

A request is (request_id, text, mode, language, asked_at); its key holds the mode, so one mode never gets
another's answer. Each micro-batch looks its distinct keys up among the answers of earlier batches and
has only the others answered, once for each key. Answers of the tiers in ``NEVER_KEPT`` are not kept.

State is a table of appended folders, ``memo/until=<second>/batch=<number>``, in a folder that all executors
share: a lookup reads no folder that has expired (partition pruning), folders are deleted ``ttl`` seconds
after that (requests that arrive late still find theirs), and nothing is rewritten. A batch reads the folders of earlier batches only and overwrites its own, so a
batch that is repeated after a crash leaves no duplicates, and a restarted stream finds its memo. Served
answers are read back from that table, so a generator that answers differently each time is asked once.

An answer is served until ``ttl`` seconds after it was made, by the latest ``asked_at`` of the batch. A null
``asked_at`` counts as second 0; a null text is a key of its own. Repeated requests each get their row. An
empty batch writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ladder import NEVER_KEPT, cache_key

MEMO = "key string, answer string, tier string, keep boolean, made_at long, until long, batch long"


def drop_expired(spark: SparkSession, folder: str, now: int) -> None:
    """Delete the folders whose answers had all expired at second ``now``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(path):
        name = f.getPath().getName()
        if name.startswith("until=") and int(name.removeprefix("until=")) <= now:
            fs.delete(f.getPath(), True)


def serve(batch: DataFrame, number: int, answer: Callable[[DataFrame], DataFrame], folder: str, ttl: int) -> None:
    """Answer one micro-batch into ``folder``/answers/batch=<number>; see the module."""
    spark, memo = batch.sparkSession, f"{folder}/memo"
    key = F.concat(F.when(F.col("text").isNull(), "null|").otherwise(""), cache_key("text", "mode", "language"))
    asked = batch.select("request_id", "text", "mode", "language", F.coalesce(F.col("asked_at").cast("long"), F.lit(0)).alias("asked_at"), key.alias("key"))
    # one row for each key before anything is shuffled by it
    first = F.min(F.struct("asked_at", "request_id", "text", "mode", "language")).alias("r")
    keys = asked.groupBy("key").agg(first).select("key", "r.*").persist()
    try:
        now = asked.agg(F.max("asked_at")).first()[0]
        if now is None:
            return
        spark.createDataFrame([], MEMO).drop("until", "batch").write.mode("ignore").parquet(f"{memo}/until=0/batch=-1")
        table = spark.read.schema(MEMO).parquet(memo)
        known = table.filter((F.col("until") > now) & (F.col("batch") < number) & F.col("keep") & (F.col("made_at") > now - ttl))
        latest = F.max_by(F.struct("answer", "tier"), F.struct("made_at", "batch")).alias("a")
        hits = known.join(keys.select("key"), "key", "left_semi").groupBy("key").agg(latest).select("key", "a.answer", "a.tier")
        made = answer(keys.join(hits, "key", "left_anti").select("key", "text", "mode", "language"))
        fresh = made.select("key", "answer", "tier", (~F.col("tier").isin(*NEVER_KEPT)).alias("keep"), F.lit(now).alias("made_at"))
        own = f"{memo}/until={now + ttl}/batch={number}"
        fresh.write.mode("overwrite").parquet(own)
        fresh = spark.read.schema(fresh.schema).parquet(own)
        served = hits.withColumns({"keep": F.lit(True), "old": F.lit(True)}).unionByName(fresh.drop("made_at").withColumn("old", F.lit(False)))
        served = served.join(keys.select("key", F.col("request_id").alias("first_id")), "key")
        from_memo = F.col("old") | (F.col("keep") & ~F.col("request_id").eqNullSafe(F.col("first_id")))
        out = asked.select("request_id", "mode", "key").join(served, "key").select("request_id", "mode", "answer", "tier", F.coalesce(from_memo, F.lit(False)).alias("from_memo"))
        out.write.mode("overwrite").parquet(f"{folder}/answers/batch={number}")
        drop_expired(spark, memo, now - ttl)
    finally:
        keys.unpersist()


def memo_stream(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, ttl: int = 3600) -> StreamingQuery:
    """Answer a stream of requests with a memo. ``answer`` takes (key, text, mode, language) and gives (key, answer, tier)."""
    run = lambda batch, number: serve(batch, number, answer, folder, ttl)
    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
