"""Concept graph: edges, nodes, entry points and the bounded weighted walk.

The walk keeps the semantics of a first-in first-out queue: a row is accepted if it beats what its
node had so far, and an accepted row is expanded while fewer than ``max_nodes`` nodes are known.
Since a queue empties level by level, each level is one frame in queue order, and the running
maximum and the running count are window functions over it. The number of hops is fixed, so the
levels unroll into one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import alnum
from ..sources import snapshot

# --- fixed values -----------------------------------------------------------------------------
EDGE_WEIGHTS = {
    "governed_by": 1.00,
    "classifies": 1.00,
    "flagged_by": 0.95,
    "rests_on": 0.90,
    "scoped_to_district": 0.80,
    "scoped_to_sector": 0.80,
    "in_scheme": 0.40,
    "prose_link": 0.30,
}
TYPE_PRIORITY = (
    "incentive",
    "eligibility_rule",
    "ambiguity_flag",
    "act",
    "district_classification",
    "district",
    "sector",
    "glossary_term",
    "authority",
    "scheme",
)
HUB_TYPES = ("scheme",)
HUB_EXPANDS = ("incentive", "eligibility_rule", "ambiguity_flag", "act")
STOPWORDS = (
    "the", "and", "for", "with", "from", "policy", "scheme", "subsidy", "incentive", "bihar", "msme",
    "enterprise", "enterprises", "state", "district", "districts", "sector", "sectors", "other", "general",
)
# ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class WalkConfig:
    max_hops: int = 2
    fan_out: int = 8
    hub_fan_out: int = 6
    max_nodes: int = 24
    decay: float = 0.6
    reverse_factor: float = 0.6
    min_alias_length: int = 4
    hub_types: tuple[str, ...] = HUB_TYPES
    hub_expands: tuple[str, ...] = HUB_EXPANDS
    type_priority: tuple[str, ...] = TYPE_PRIORITY

    @classmethod
    def of(cls, given: dict | None) -> WalkConfig:
        """Defaults overlaid with the known keys of ``given``."""
        return cls(**{k: v for k, v in (given or {}).items() if k in cls.__dataclass_fields__})


def typed_edges(refs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """refs: src, dst, kind -> distinct edges with weights, no self loops; a kind without a weight counts as prose."""
    w = weights or EDGE_WEIGHTS
    table = F.create_map(*[F.lit(x) for kv in w.items() for x in kv])
    return refs.filter("src is not null and dst is not null and src <> dst").dropDuplicates(["src", "dst", "kind"]).withColumn("w", F.coalesce(table[F.col("kind")], F.lit(w.get("prose_link", 0.3))))


def priority_dedup(rows: DataFrame, key: str, preference: Column, *ties: str) -> DataFrame:
    """One row per key: the smallest preference, then ties."""
    w = W.partitionBy(key).orderBy(preference, *ties)
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def alias_table(nodes: DataFrame, min_length: int = 4, stopwords=STOPWORDS) -> DataFrame:
    """nodes: concept_id, aliases -> (alias, concept_id); short aliases and those of stopwords alone are left out."""
    a = nodes.select("concept_id", F.explode("aliases").alias("raw")).select("concept_id", alnum(F.col("raw")).alias("alias")).distinct()
    return a.filter((F.length("alias") >= min_length) & F.exists(F.split("alias", " "), lambda w: ~w.isin(*stopwords)))


def alias_matches(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases of any length contained in a question as whole words.

    A question's word n-grams are exploded and joined on equality, for the numbers n of words that aliases have (one small aggregate).
    """
    words = F.col("__words")  # made once a question: what a lambda names from outside is computed anew for every element
    lengths = aliases.agg(F.array_sort(F.collect_set(F.size(F.split("alias", " ")))).alias("__lengths"))
    grams = F.flatten(F.transform(F.col("__lengths"), lambda n: F.transform(F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(words, i, n), " "))))
    split = questions.select("query_id", F.explode(F.array(F.split(alnum(F.col("text")), " "))).alias("__words"))
    asked = split.join(F.broadcast(lengths), F.lit(True))
    return asked.select("query_id", F.explode(F.array_distinct(grams)).alias("alias")).join(aliases, "alias")


def entry_points(questions: DataFrame, aliases: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(query_id, concept_id, pos): seeds first in their order, then longer aliases first, then id."""
    found = alias_matches(questions, aliases).select("query_id", "concept_id", F.struct(F.lit(1).alias("late"), (-F.length("alias")).alias("a"), F.col("alias").alias("b")).alias("o"))
    if seeds is not None:
        found = found.unionByName(seeds.select("query_id", "concept_id", F.struct(F.lit(0).alias("late"), F.col("pos").cast("int").alias("a"), F.lit("").alias("b")).alias("o")))
    firsts = found.groupBy("query_id", "concept_id").agg(F.min("o").alias("o"))
    return firsts.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy("o", "concept_id"))).select("query_id", "concept_id", "pos")


def neighbours(edges: DataFrame, reverse_factor: float) -> DataFrame:
    """Both directions of each edge; the reverse one is discounted and its kind marked."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat("kind", F.lit("~")).alias("kind"), (F.col("w") * reverse_factor).alias("w"))
    return edges.select("src", "dst", "kind", "w").unionByName(back)


def best_steps(steps: DataFrame, priority: Column, cfg: WalkConfig) -> DataFrame:
    """The steps that a walk can take: the best of each node, and the best of a hub among the types that it expands to.

    Which neighbours of a node are taken doesn't depend on the question, so a node with very many is cut once, not for every question that comes by it.
    """
    most, best_first = max(cfg.fan_out, cfg.hub_fan_out), [F.desc("w"), priority, "dst", "kind"]
    allowed = F.col("to_type").isin(*cfg.hub_expands)
    ranks = {"__any": F.row_number().over(W.partitionBy("src").orderBy(*best_first)), "__hub": F.row_number().over(W.partitionBy("src", allowed).orderBy(*best_first))}
    return steps.withColumns(ranks).filter((F.col("__any") <= most) | allowed & (F.col("__hub") <= most)).drop("__any", "__hub")


def held(df: DataFrame) -> DataFrame:
    """A level that later ones read several times: written to the session's checkpoint folder if it has one, else cached (and made anew if lost)."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def walk(nodes: DataFrame, edges: DataFrame, entries: DataFrame, cfg: WalkConfig = WalkConfig(), many: bool = False) -> DataFrame:
    """(query_id, concept_id, score, hop, via, position); nodes: concept_id, entity_type; entries: query_id, concept_id, pos.

    With ``many`` queries the steps are cut to the best of each node before they meet the queries (``best_steps``); the result is the same.
    """
    kinds = nodes.select("concept_id", "entity_type")
    priority = F.coalesce(F.create_map(*[F.lit(x) for k, t in enumerate(cfg.type_priority) for x in (t, k)])[F.col("to_type")], F.lit(99)) if cfg.type_priority else F.lit(99)
    steps = neighbours(edges, cfg.reverse_factor).join(kinds.select(F.col("concept_id").alias("dst"), F.col("entity_type").alias("to_type")), "dst")
    steps = held(best_steps(steps, priority, cfg)) if many else steps
    level = entries.join(kinds, "concept_id").select("query_id", F.col("pos").alias("ord"), "concept_id", "entity_type", F.lit(1.0).alias("score"), F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via"))
    accepted, known = None, None
    for hop in range(cfg.max_hops + 1):
        earlier = W.partitionBy("query_id", "concept_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
        rows = level.withColumn("__max", F.max("score").over(earlier))
        if known is None:
            rows = rows.withColumns({"__old": F.lit(None).cast("double"), "__base": F.lit(0).cast("long")})
        else:
            rows = rows.join(known.select("query_id", "concept_id", F.col("score").alias("__old")), ["query_id", "concept_id"], "left")
            rows = rows.join(known.groupBy("query_id").agg(F.count("*").alias("__base")), "query_id", "left")
        rows = rows.filter((F.col("score") > F.coalesce("__old", F.lit(-1.0))) & (F.col("score") > F.coalesce("__max", F.lit(-1.0))))
        fresh = F.when(F.col("__old").isNull() & F.col("__max").isNull(), 1).otherwise(0)
        rows = rows.withColumn("__n", F.coalesce("__base", F.lit(0)) + F.sum(fresh).over(W.partitionBy("query_id").orderBy("ord")))
        got = rows.select("query_id", "concept_id", "score", "hop", "via", "ord", "entity_type", "__n")
        got = held(got) if hop < cfg.max_hops else got
        accepted = got.drop("__n", "entity_type") if accepted is None else accepted.unionByName(got.drop("__n", "entity_type"))
        if hop == cfg.max_hops:
            break
        known = accepted.groupBy("query_id", "concept_id").agg(F.max("score").alias("score"))
        grow = got.filter(F.col("__n") < cfg.max_nodes).withColumn("hub", F.lit(hop > 0) & F.col("entity_type").isin(*cfg.hub_types))
        out = grow.join(steps, F.col("concept_id") == F.col("src")).filter(~F.col("hub") | F.col("to_type").isin(*cfg.hub_expands))
        best_first = W.partitionBy("query_id", "ord").orderBy(F.desc("w"), priority, "dst", "kind")
        out = out.withColumn("r", F.row_number().over(best_first)).filter(F.col("r") <= F.when(F.col("hub"), cfg.hub_fan_out).otherwise(cfg.fan_out))
        in_queue = W.partitionBy("query_id").orderBy("ord", "r")
        level = out.select("query_id", F.row_number().over(in_queue).alias("ord"), F.col("dst").alias("concept_id"), F.col("to_type").alias("entity_type"), (F.col("score") * F.col("w") * cfg.decay).alias("score"), F.lit(hop + 1).alias("hop"), F.col("kind").alias("via"))
    last = W.partitionBy("query_id", "concept_id").orderBy(F.desc("score"), "hop", "ord")
    best = accepted.withColumn("__r", F.row_number().over(last)).filter("__r = 1")
    best = best.withColumn("score", F.round("score", 9))
    ranked = best.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "hop", "concept_id")))
    return ranked.filter(F.col("position") <= cfg.max_nodes).select("query_id", "concept_id", "score", "hop", "via", "position")


def graph_gate(queries: DataFrame, walked: DataFrame, trust: DataFrame) -> DataFrame:
    """abstain without nodes; low confidence if all are unverified; else answer. trust: concept_id, trust."""
    n = walked.join(trust, "concept_id", "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("trust", F.lit("unverified")) != "unverified").alias("trusted"))
    out = queries.select("query_id").join(n, "query_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)).cast("long"), "trusted": F.coalesce("trusted", F.lit(0)).cast("long")})
    action = F.when(F.col("n") == 0, "abstain").when(F.col("trusted") == 0, "answer_low_confidence").otherwise("answer")
    score = F.when(F.col("n") == 0, 0.0).when(F.col("trusted") == 0, 0.5).otherwise(1.0)
    return out.select("query_id", "n", "trusted", action.alias("action"), score.alias("top_score"))


NODE_COLUMNS = "concept_id string, entity_type string, title string, aliases array<string>, domain_id string, trust string, status string, summary string, chunk_ids array<string>, finding_ids array<string>"
EDGE_COLUMNS = "src string, dst string, kind string, w double"


def shaped(df: DataFrame, columns: str) -> DataFrame:
    """The declared columns; those that df lacks are null."""
    pairs = [c.split(" ", 1) for c in columns.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in pairs])


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> snapshot.Manifest:
    """Publish nodes and edges as one version of the graph; readers see both tables of a version or the one before."""
    return snapshot.write({"nodes": shaped(nodes, NODE_COLUMNS), "edges": shaped(edges, EDGE_COLUMNS)}, folder)


def read_graph(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the last version; a graph that isn't published or has lost files is empty, so answers go on without it."""
    if all(snapshot.complete(spark, folder, n) for n in ("nodes", "edges")):
        found = snapshot.read(spark, folder)
        return found["nodes"], found["edges"]
    return spark.createDataFrame([], NODE_COLUMNS), spark.createDataFrame([], EDGE_COLUMNS)
