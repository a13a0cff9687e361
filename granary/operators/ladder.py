"""Tiers of a batch of requests (query, mode) from evidence that is already at hand, memo keys and source lists.

``tiers`` only names the tier; ``answers.answer`` runs the cascade and writes the answers. The gate is
computed from vector evidence alone, from a frame that never joins the graph, so graph rows can add
sources but never turn an abstention of plain retrieval around.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_TRUSTED, GRAPH_OVERRIDES_GATE = 2, True
#: Tiers whose answers no memo keeps.
NEVER_KEPT = ("abstain", "greeting", "grievance")


def cache_key(text, mode, language):
    return F.concat_ws("|", mode, language, F.lower(F.trim(text)))


def tiers(requests: DataFrame) -> DataFrame:
    """Tier of each request.

    requests: query_id, mode, intent, retrieval_mode, n_matches, category, has_rate, gate (vector),
    graph_nodes, graph_trusted, graph_chunks, dominant, lookup.
    """
    rag = F.col("mode") == "rag"
    gate = F.when(F.col("mode") == "records", F.when(F.col("graph_nodes") == 0, "abstain").when(F.col("graph_trusted") == 0, "answer_low_confidence").otherwise("answer")).otherwise(F.col("gate"))
    graph_ok = ~rag & F.lit(GRAPH_OVERRIDES_GATE) & (F.col("graph_trusted") >= MIN_TRUSTED) & (F.col("graph_chunks") > 0)
    lookup = ~rag & (F.col("retrieval_mode") == "record_lookup") & (F.col("n_matches") == 1) & F.col("category").isNotNull() & F.col("has_rate")
    tier = (
        F.when(F.col("intent").isin("greeting", "grievance"), F.col("intent"))
        .when(lookup, "record_lookup")
        .when((gate == "abstain") & graph_ok, "graph")
        .when(gate == "abstain", "abstain")
        .when((F.col("mode") != "records") & F.col("lookup") & F.col("dominant") & (F.col("intent") == "policy_qa"), "extractive")
        .otherwise("synthesis")
    )
    return requests.withColumns({"final_gate": gate, "tier": tier, "low_confidence": (gate == "answer_low_confidence") & ~tier.isin("record_lookup", "graph", "abstain", "greeting", "grievance"), "cached": ~tier.isin(*NEVER_KEPT)})


def first_of_equal(requests: DataFrame, key: str, order: str) -> DataFrame:
    """Memo of a batch: the first request of each key is answered, the others point to it."""
    firsts = requests.groupBy(key).agg(F.min(order).alias("answered_by"), F.count("*").alias("n_requests"))
    return requests.join(firsts, key).withColumn("cached", F.col(order) != F.col("answered_by"))


def append_sources(primary: DataFrame, extra: DataFrame, key: str = "doc_id") -> DataFrame:
    """Extra sources that are not cited yet, after the primary ones, tagged on; both have query_id, key and pos."""
    new = extra.join(primary.select("query_id", key), ["query_id", key], "left_anti")
    both = primary.select("query_id", key, "pos", F.lit("vector").alias("origin"), F.lit(0).alias("__late")).unionByName(new.select("query_id", key, "pos", F.lit("graph").alias("origin"), F.lit(1).alias("__late")))
    from pyspark.sql import Window as W

    w = W.partitionBy("query_id").orderBy("__late", "pos", key)
    return both.withColumn("position", F.row_number().over(w)).withColumn("tag", F.concat(F.lit("S"), "position")).drop("__late", "pos")
