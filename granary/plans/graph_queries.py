"""Queries over graph operators, with their SQL (the walk's levels unrolled)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compilation as C
from ..operators import graph as G
from .inline import QUESTION_TYPES, QUESTIONS, frame
from .retrieval_queries import table

#: Kinds of nodes and links that the relational tables stand in for.
WEIGHTS = {"in_scheme": 0.4, "scoped_to_sector": 0.8, "governed_by": 1.0, "flagged_by": 0.95}
PRIORITY = ("incentive", "eligibility_rule", "sector", "scheme")


def nodes(s, d) -> DataFrame:
    part = lambda t, key, name, kind, entity: table(s, d, t).select(F.concat(F.lit(kind + "/"), F.col(key)).alias("concept_id"), F.lit(entity).alias("entity_type"), F.col(name).alias("title"))
    return C.union_all([part("region", "r_regionkey", "r_name", "region", "scheme"), part("nation", "n_nationkey", "n_name", "nation", "sector"), part("customer", "c_custkey", "c_name", "customer", "incentive"), part("supplier", "s_suppkey", "s_name", "supplier", "eligibility_rule")])


def refs(s, d) -> DataFrame:
    link = lambda df, src, dst, kind: df.select(F.concat(F.lit(src[0]), src[1]).alias("src"), F.concat(F.lit(dst[0]), dst[1]).alias("dst"), F.lit(kind).alias("kind"))
    c, n, p = table(s, d, "customer"), table(s, d, "nation"), table(s, d, "supplier")
    return C.union_all(
        [
            link(n, ("nation/", F.col("n_nationkey")), ("region/", F.col("n_regionkey")), "in_scheme"),
            link(c, ("customer/", F.col("c_custkey")), ("nation/", F.col("c_nationkey")), "scoped_to_sector"),
            link(p, ("supplier/", F.col("s_suppkey")), ("nation/", F.col("s_nationkey")), "governed_by"),
            link(c, ("customer/", F.col("c_custkey")), ("supplier/", F.col("c_custkey") % 100), "flagged_by"),
            link(n, ("nation/", F.col("n_nationkey")), ("nation/", F.col("n_nationkey")), "in_scheme"),
        ]
    )


def edges(s, d) -> DataFrame:
    return G.typed_edges(refs(s, d), WEIGHTS)


ENTRIES = [(0, "nation/3", 1), (1, "region/0", 1), (2, "customer/7", 1), (2, "supplier/5", 2), (3, "nation/1", 1), (3, "nation/2", 2), (4, "none/1", 1)]


def entries(s) -> DataFrame:
    return s.createDataFrame(ENTRIES, "query_id long, concept_id string, pos int")


def walked(s, d, **cfg) -> DataFrame:
    return G.walk(nodes(s, d), edges(s, d), entries(s), G.WalkConfig(type_priority=PRIORITY, **cfg))


NODES_SQL = """nodes AS (SELECT 'region/' || r_regionkey AS concept_id, 'scheme' AS entity_type, r_name AS title FROM region UNION ALL SELECT 'nation/' || n_nationkey, 'sector', n_name FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, 'incentive', c_name FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, 'eligibility_rule', s_name FROM supplier)"""
EDGES_SQL = """edges AS (SELECT DISTINCT src, dst, kind, CASE kind WHEN 'in_scheme' THEN 0.4e0 WHEN 'scoped_to_sector' THEN 0.8e0 WHEN 'governed_by' THEN 1e0 ELSE 0.95e0 END AS w FROM (
  SELECT 'nation/' || n_nationkey AS src, 'region/' || n_regionkey AS dst, 'in_scheme' AS kind FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'scoped_to_sector' FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'governed_by' FROM supplier
  UNION ALL SELECT 'customer/' || c_custkey, 'supplier/' || (c_custkey % 100), 'flagged_by' FROM customer) WHERE src <> dst)"""


def walk_sql(max_hops: int = 2, fan_out: int = 8, hub_fan_out: int = 6, max_nodes: int = 24, given: tuple[str, ...] | None = None, priority: tuple[str, ...] = PRIORITY) -> str:
    """CTEs of a walk, the last one ``walked``; ``given`` are CTEs nodes, edges and entries to take instead of those of this module."""
    rows = ", ".join(f"({q}, '{c}', {p})" for q, c, p in ENTRIES)
    given = given or (NODES_SQL, EDGES_SQL, f"entries AS (SELECT * FROM (VALUES {rows}) AS e(query_id, concept_id, pos))")
    rank = " ".join(f"WHEN '{t}' THEN {k}" for k, t in enumerate(priority))
    out = [
        *given,
        f"steps AS (SELECT b.*, n.entity_type AS to_type, CASE n.entity_type {rank} ELSE 99 END AS pr FROM (SELECT src, dst, kind, w FROM edges UNION ALL SELECT dst, src, kind || '~', w * 0.6e0 FROM edges) b JOIN nodes n ON n.concept_id = b.dst)",
        "l0 AS (SELECT e.query_id, e.pos AS ord, e.concept_id, n.entity_type, 1e0 AS score, 0 AS hop, CAST(NULL AS VARCHAR) AS via FROM entries e JOIN nodes n USING (concept_id))",
        "k0 AS (SELECT query_id, concept_id, score FROM l0 WHERE FALSE)",
    ]
    for h in range(max_hops + 1):
        out.append(f"""a{h} AS (SELECT *, base + sum(CASE WHEN old IS NULL AND mx IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY ord) AS n FROM (
          SELECT l.*, max(l.score) OVER (PARTITION BY l.query_id, l.concept_id ORDER BY l.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx, k.score AS old, coalesce(c.base, 0) AS base
          FROM l{h} l LEFT JOIN k{h} k ON k.query_id = l.query_id AND k.concept_id = l.concept_id LEFT JOIN (SELECT query_id, count(*) AS base FROM k{h} GROUP BY query_id) c ON c.query_id = l.query_id)
          WHERE score > coalesce(old, -1) AND score > coalesce(mx, -1))""")
        if h < max_hops:
            union = " UNION ALL ".join(f"SELECT query_id, concept_id, score FROM a{i}" for i in range(h + 1))
            out.append(f"k{h + 1} AS (SELECT query_id, concept_id, max(score) AS score FROM ({union}) GROUP BY ALL)")
            hub = "a.entity_type = 'scheme'" if h else "FALSE"
            out.append(f"""l{h + 1} AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ord, r) AS ord, dst AS concept_id, to_type AS entity_type, score * w * 0.6e0 AS score, {h + 1} AS hop, kind AS via FROM (
              SELECT a.query_id, a.ord, a.score, s.dst, s.to_type, s.w, s.kind, {hub} AS hub, row_number() OVER (PARTITION BY a.query_id, a.ord ORDER BY s.w DESC, s.pr, s.dst, s.kind) AS r
              FROM a{h} a JOIN steps s ON s.src = a.concept_id WHERE a.n < {max_nodes} AND (NOT ({hub}) OR s.to_type IN ('incentive', 'eligibility_rule', 'ambiguity_flag', 'act')))
              WHERE r <= CASE WHEN hub THEN {hub_fan_out} ELSE {fan_out} END)""")
    union = " UNION ALL ".join(f"SELECT query_id, concept_id, score, hop, via, ord FROM a{i}" for i in range(max_hops + 1))
    out.append(f"""walked AS (SELECT query_id, concept_id, score, hop, via, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hop, concept_id) AS position FROM (
      SELECT query_id, concept_id, round(score, 9) AS score, hop, via FROM (SELECT *, row_number() OVER (PARTITION BY query_id, concept_id ORDER BY score DESC, hop, ord) AS r FROM ({union})) WHERE r = 1)) WHERE position <= {max_nodes})""")
    return ", ".join(out)


def trust(s, d) -> DataFrame:
    return table(s, d, "labels").select(F.concat(F.lit("customer/"), F.col("doc_id")).alias("concept_id"), F.when(F.col("quality") == 1, "machine-confirmed").otherwise("unverified").alias("trust"))


def gate(s, d) -> DataFrame:
    qs = s.range(6).select(F.col("id").alias("query_id"))
    return G.graph_gate(qs, walked(s, d), trust(s, d))


def rollup(s, d) -> DataFrame:
    from ..operators.retrieval import ordered_distinct

    w = walked(s, d).join(nodes(s, d).select("concept_id", "entity_type"), "concept_id")
    chunks = ordered_distinct(w.filter("entity_type = 'incentive'"), ["query_id"], "concept_id", "position", None, "chunk_ids")
    kinds = ordered_distinct(w, ["query_id"], "entity_type", "position", None, "kinds")
    return kinds.join(chunks, "query_id", "left")


def one_hop(s, d) -> DataFrame:
    return walked(s, d, max_hops=1, max_nodes=1000)


def build_nodes(s, d) -> DataFrame:
    """Nodes with the number of their chunks, the first chunk id, alias and trust."""
    from ..functions.text import alnum

    e = edges(s, d).filter("kind = 'scoped_to_sector'").groupBy(F.col("dst").alias("concept_id")).agg(F.count("*").alias("n_chunks"), F.min("src").alias("first_chunk"))
    n = nodes(s, d).join(e, "concept_id", "left").join(trust(s, d), "concept_id", "left")
    return n.select("concept_id", "entity_type", "title", alnum(F.col("title")).alias("alias"), F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), "first_chunk", F.coalesce("trust", F.lit("unverified")).alias("trust"))


def aliases(s, d) -> DataFrame:
    p = table(s, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id")).select(F.concat(F.lit("part/"), F.col("id")).alias("concept_id"), F.array("p_name").alias("aliases"))
    n = nodes(s, d).filter("entity_type in ('scheme', 'sector')").select("concept_id", F.array("title").alias("aliases"))
    return G.alias_table(p.unionByName(n))


def entry_query(s, d) -> DataFrame:
    return G.entry_points(frame(s, QUESTIONS, QUESTION_TYPES), aliases(s, d))


STOP = ", ".join(f"'{w}'" for w in G.STOPWORDS)
ENTRY_SQL = f"""WITH questions AS ({QUESTIONS}), named AS (SELECT 'part/' || min(p_partkey) AS concept_id, p_name AS raw FROM part GROUP BY p_name
    UNION ALL SELECT 'region/' || r_regionkey, r_name FROM region UNION ALL SELECT 'nation/' || n_nationkey, n_name FROM nation),
  alias AS (SELECT DISTINCT concept_id, array_to_string(regexp_extract_all(lower(raw), '[a-z0-9]+'), ' ') AS alias FROM named),
  usable AS (SELECT * FROM alias WHERE length(alias) >= 4 AND len(list_filter(string_split(alias, ' '), lambda w: w NOT IN ({STOP}))) > 0),
  hit AS (SELECT q.query_id, u.concept_id, min((-length(alias), alias)) AS o FROM questions q JOIN usable u ON contains(' ' || array_to_string(regexp_extract_all(lower(q.text), '[a-z0-9]+'), ' ') || ' ', ' ' || u.alias || ' ') GROUP BY ALL)
  SELECT CAST(query_id AS BIGINT) AS query_id, concept_id, row_number() OVER (PARTITION BY query_id ORDER BY o, concept_id) AS pos FROM hit"""


def dedup(s, d) -> DataFrame:
    part = lambda t, key, pref: table(s, d, t).select(F.col(key).cast("long").alias("domain_id"), F.lit(pref).alias("pref"), F.lit(t).alias("entity"))
    rows = C.union_all([part("nation", "n_nationkey", 0), part("supplier", "s_suppkey", 1), part("part", "p_partkey", 2), part("customer", "c_custkey", 3)])
    return G.priority_dedup(rows, "domain_id", F.col("pref"), "entity")


TRUST_SQL = "trust AS (SELECT 'customer/' || doc_id AS concept_id, CASE WHEN quality = 1 THEN 'machine-confirmed' ELSE 'unverified' END AS trust FROM labels)"
WIDE = {"fan_out": 100_000, "hub_fan_out": 100_000, "max_nodes": 1_000_000}

QUERIES = {
    "alias_entry_points": entry_query,
    "priority_dedup": dedup,
    "graph_edges_build": edges,
    "graph_nodes_build": build_nodes,
    "graph_expand_1hop": one_hop,
    "graph_walk_2hop": lambda s, d: walked(s, d, **WIDE).groupBy("query_id", "hop").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"), F.min("concept_id").alias("first")),
    "graph_hub_suppressed": lambda s, d: walked(s, d, max_nodes=100_000, fan_out=20),
    "graph_walk_capped": walked,
    "evidence_rollup": rollup,
    "graph_gate": gate,
}
SQL = {
    "alias_entry_points": ENTRY_SQL,
    "priority_dedup": "SELECT domain_id, CAST(pref AS BIGINT) AS pref, entity FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY pref, entity) AS r FROM (SELECT CAST(n_nationkey AS BIGINT) AS domain_id, 0 AS pref, 'nation' AS entity FROM nation UNION ALL SELECT s_suppkey, 1, 'supplier' FROM supplier UNION ALL SELECT p_partkey, 2, 'part' FROM part UNION ALL SELECT c_custkey, 3, 'customer' FROM customer)) WHERE r = 1",
    "graph_edges_build": f"WITH {EDGES_SQL} SELECT * FROM edges",
    "graph_nodes_build": f"""WITH {NODES_SQL}, {EDGES_SQL}, {TRUST_SQL} SELECT n.concept_id, n.entity_type, n.title, array_to_string(regexp_extract_all(lower(n.title), '[a-z0-9]+'), ' ') AS alias, coalesce(e.n, 0) AS n_chunks, e.f AS first_chunk, coalesce(t.trust, 'unverified') AS trust
      FROM nodes n LEFT JOIN (SELECT dst, count(*) AS n, min(src) AS f FROM edges WHERE kind = 'scoped_to_sector' GROUP BY dst) e ON e.dst = n.concept_id LEFT JOIN trust t USING (concept_id)""",
    "graph_expand_1hop": f"WITH {walk_sql(max_hops=1, max_nodes=1000)} SELECT * FROM walked",
    "graph_walk_2hop": f"WITH {walk_sql(**WIDE)} SELECT query_id, hop, count(*) AS n, round(sum(score), 4) AS total, min(concept_id) AS first FROM walked GROUP BY ALL",
    "graph_hub_suppressed": f"WITH {walk_sql(max_nodes=100_000, fan_out=20)} SELECT * FROM walked",
    "graph_walk_capped": f"WITH {walk_sql()} SELECT * FROM walked",
    "evidence_rollup": f"""WITH {walk_sql()}, w AS (SELECT * FROM walked JOIN nodes USING (concept_id)),
      k AS (SELECT query_id, string_agg(entity_type, ',' ORDER BY p, entity_type) AS kinds FROM (SELECT query_id, entity_type, min(position) AS p FROM w GROUP BY ALL) GROUP BY query_id),
      c AS (SELECT query_id, string_agg(concept_id, ',' ORDER BY position) AS chunk_ids FROM w WHERE entity_type = 'incentive' GROUP BY query_id)
      SELECT k.query_id, k.kinds, c.chunk_ids FROM k LEFT JOIN c USING (query_id)""",
    "graph_gate": f"""WITH {walk_sql()}, {TRUST_SQL}, g AS (SELECT query_id, count(*) AS n, count(*) FILTER (coalesce(trust, 'unverified') <> 'unverified') AS trusted FROM walked LEFT JOIN trust USING (concept_id) GROUP BY query_id)
      SELECT q.query_id, coalesce(n, 0) AS n, coalesce(trusted, 0) AS trusted, CASE WHEN coalesce(n, 0) = 0 THEN 'abstain' WHEN trusted = 0 THEN 'answer_low_confidence' ELSE 'answer' END AS action,
        CASE WHEN coalesce(n, 0) = 0 THEN 0e0 WHEN trusted = 0 THEN 0.5e0 ELSE 1e0 END AS top_score FROM range(6) AS q(query_id) LEFT JOIN g ON g.query_id = q.query_id""",
}
