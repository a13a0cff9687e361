"""Queries over rendering, note records, findings and evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as K
from ..operators import notes as N
from ..sources import vault
from .graph_queries import entries, nodes, walk_sql, walked
from .record_queries import NAMED, named
from .retrieval_queries import table


def incentives(s, d):
    p = table(s, d, "part")
    scheme = F.concat(F.lit("B"), F.col("p_size") % 3)
    rules = F.array(F.concat(scheme, F.lit("-S"), F.col("p_size"), F.lit(".1-a")), F.concat(scheme, F.lit("-S"), F.col("p_size"), F.lit(".1-b")), F.lit("X-2"))
    rates = F.array(F.struct(F.when(F.col("p_size") % 2 == 0, "other").otherwise("micro").alias("category"), F.col("p_brand").alias("rate_text")))
    return p.select(F.col("p_partkey").alias("incentive_id"), scheme.alias("scheme_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 5 == 0, F.lit("7")).alias("item_no"), (F.col("p_size") % 4).alias("page"), rates.alias("rates"), F.when(F.col("p_size") % 7 == 0, F.array().cast("array<string>")).otherwise(rules).alias("rule_ids"), F.when(F.col("p_size") % 3 == 0, F.array(F.lit("B0-AMB-1"), F.lit("AMB-2"))).otherwise(F.array().cast("array<string>")).alias("flags"))


def schemes(s):
    return s.createDataFrame([("B0", "draft, v 1", "active", "Plan B", "B"), ("B1", None, "notified", None, "Short")], "scheme_id string, version string, status string, name string, short_name string")


def region_lists(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return K.list_chunks(n, "r_name", "n_name", "n_nationkey", K.citation_header(F.lit("Atlas"), F.col("r_name"), F.lit(3)), F.lit("Members: "), F.lit(" Note: listed once."))


def every_gap(s, d):
    docs = table(s, d, "documents").select("source", "doc_id")
    return K.every_gap(docs.filter("source is not null"), docs.join(table(s, d, "labels").select("doc_id"), "doc_id", "left_semi"), "source", "doc_id")


def prompts(s, d):
    items = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(s, d, "documents").filter("doc_id % 3 < 2").select((F.col("doc_id") / 3).cast("long").alias("query_id"), (F.col("doc_id") % 3 + 1).alias("position"), F.concat_ws(" > ", "source", "lang").alias("clause_path"), F.nullif(F.col("doc_id") % 4, F.lit(0).cast("long")).alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return K.prompt_message(docs, items).select("query_id", F.md5(F.col("message").cast("binary")).alias("digest"), F.length("message").alias("n_chars"))


def checked(s, d):
    parts = named(s, d).select(F.lit("incentive").alias("entity_type"), F.concat(F.lit("I"), "name_id").alias("id"), F.lit(None).cast("string").alias("condition_text"), "rates")
    more = table(s, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "eligibility_rule").otherwise("sector").alias("entity_type"), F.concat(F.lit("R"), "s_suppkey").alias("id"), F.col("s_name").alias("condition_text"), F.lit(None).cast("array<struct<category:string,rate_text:string>>").alias("rates"))
    return K.checked_fields(parts.unionByName(more))


def vault_roundtrip(s, d):
    """Every nation and customer as a record, to a note, and back."""
    source = lambda key: F.struct(F.concat(F.lit("S"), key % 3).alias("source_id"), F.lit("https://e.org/").alias("source_url"), key.alias("page_start"), F.when(key % 3 == 0, "superseded").when(key % 3 == 1, "disputed").otherwise("confirmed").alias("verification_status"))
    a, b = F.col("n_nationkey"), F.col("c_custkey")
    n = table(s, d, "nation").select(F.lit("district").alias("entity"), F.to_json(F.struct(F.concat(F.lit("D"), a).alias("district_id"), F.col("n_name").alias("name"), source(a).alias("source"))).alias("record"))
    c = table(s, d, "customer").select(F.lit("incentive").alias("entity"), F.to_json(F.struct(F.concat(F.lit("I"), b).alias("incentive_id"), F.col("c_name").alias("name"), F.lit("open").alias("status"), source(b).alias("source"))).alias("record"))
    # what a record was passes through beside it, so that nothing is joined on texts; rows that share a record stay as many as they are
    given = n.unionByName(c).withColumns({"was": F.col("record"), "of": F.col("entity")})
    back = vault.records_of(vault.notes_of(given, "round trip", kept=("was", "of")), kept=("was", "of"))
    at = lambda c, path: F.get_json_object(c, path)
    both = back.filter("entity = of and record = was")
    return both.select("entity", F.coalesce(at("record", "$.district_id"), at("record", "$.incentive_id")).alias("id"), at("front", "$.title").alias("title"), at("front", "$.status").alias("status"), at("front", "$.incentive_status").alias("renamed"), at("front", "$.sources[0].id").alias("source"))


def flagged_nodes(s, d):
    return nodes(s, d).withColumn("domain_id", F.element_at(F.split("concept_id", "/"), 2))


def findings(s, d):
    """Findings that name nodes by title in another case, by domain id, or not at all."""
    o = table(s, d, "orders").select(F.concat(F.lit("F"), "o_orderkey").alias("finding_id"), F.col("o_custkey").alias("k"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return o.join(c, "k", "left").select("finding_id", F.when(F.col("k") % 3 == 0, F.upper("c_name")).when(F.col("k") % 3 == 1, F.col("k").cast("string")).otherwise("nowhere").alias("names"))


def node_findings(s, d):
    return N.attach_findings(flagged_nodes(s, d), findings(s, d)).select("concept_id", F.array_join("finding_ids", ",").alias("finding_ids"))


def full_evidence(s, d):
    n = N.attach_findings(flagged_nodes(s, d), findings(s, d))
    chunks = table(s, d, "customer").groupBy(F.concat(F.lit("nation/"), "c_nationkey").alias("concept_id")).agg(F.array_sort(F.collect_list(F.concat(F.lit("k"), "c_custkey"))).alias("chunk_ids"))
    n = n.join(chunks, "concept_id", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>"))).withColumn("entity_type", F.when(F.col("entity_type") == "eligibility_rule", "ambiguity_flag").otherwise(F.col("entity_type")))
    return N.evidence(entries(s), walked(s, d), n)


def templates(s, d):
    b = table(s, d, "benchmark")
    intent = F.when(F.col("item_id") % 3 == 0, "grievance").when(F.col("item_id") % 3 == 1, "calculation_request").otherwise("policy_qa")
    return b.select("item_id", N.template_answer(intent, F.when(F.col("item_id") % 2 == 1, "hi").otherwise("en")).alias("answer"))


QUERIES = {
    "incentive_chunks": lambda s, d: K.incentive_chunks(incentives(s, d), schemes(s)),
    "list_chunks": region_lists,
    "gap_chunks_every": every_gap,
    "prompt_messages": prompts,
    "checked_fields": checked,
    "vault_roundtrip": vault_roundtrip,
    "node_findings": node_findings,
    "evidence_full": full_evidence,
    "intent_templates": templates,
}

FINDINGS = """fnd AS (SELECT 'F' || o_orderkey AS finding_id, lower(CASE WHEN o_custkey % 3 = 0 THEN upper(c_name) WHEN o_custkey % 3 = 1 THEN CAST(o_custkey AS VARCHAR) ELSE 'nowhere' END) AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
  titled AS (SELECT lower(title) AS name, min(concept_id) AS concept_id FROM nodes WHERE title IS NOT NULL GROUP BY 1),
  numbered AS (SELECT lower(string_split(concept_id, '/')[2]) AS name, min(concept_id) AS concept_id FROM nodes GROUP BY 1),
  of_node AS (SELECT DISTINCT concept_id, finding_id FROM fnd JOIN (SELECT * FROM titled UNION ALL SELECT * FROM numbered WHERE name NOT IN (SELECT name FROM titled)) USING (name))"""
TEMPLATE_SQL = {k: tuple("'" + t.replace("'", "''") + "'" for t in v) for k, v in N.TEMPLATES.items()}
SQL = {
    "incentive_chunks": """WITH i AS (SELECT *, 'B' || (p_size % 3) AS scheme_id, p_size % 4 AS page FROM part),
      j AS (SELECT *, CASE scheme_id WHEN 'B0' THEN 'draft_v_1' ELSE 'v1' END AS version, CASE scheme_id WHEN 'B0' THEN 'ACTIVE' WHEN 'B1' THEN 'NOTIFIED' ELSE '' END AS source_status, CASE scheme_id WHEN 'B0' THEN 'Plan B' WHEN 'B1' THEN 'Short' ELSE scheme_id END AS label,
        CASE WHEN p_size % 7 = 0 THEN '' ELSE p_size || '.1,X' END AS sections, CASE WHEN p_size % 3 = 0 THEN 'AMB-1,AMB-2' ELSE '' END AS flags, CASE WHEN p_size % 5 = 0 THEN 'Item 7 ' || p_name ELSE p_name END AS clause_path FROM i)
      SELECT lower(scheme_id) || '.' || version || '.incentive.' || regexp_replace(lower(p_name), '[ /]', '_', 'g') AS chunk_id, p_partkey AS incentive_id, clause_path, CASE WHEN p_size % 2 = 0 THEN 'other' ELSE 'micro,small,medium' END AS categories, sections, flags, source_status,
        '[' || label || ' > ' || clause_path || CASE WHEN page <> 0 THEN ' > p.' || page ELSE '' END || ']' || chr(10) || chr(10) || p_name || ': ' || p_brand || '.' || CASE WHEN sections <> '' THEN ' Governing conditions: section(s) ' || replace(sections, ',', ', ') || '.' ELSE '' END || CASE WHEN flags <> '' THEN ' Known open questions on this incentive: AMB-1, AMB-2.' ELSE '' END AS text FROM j""",
    "list_chunks": "SELECT r_name, '[Atlas > ' || r_name || ' > p.3]' || chr(10) || chr(10) || 'Members: ' || string_agg(n_name, ', ' ORDER BY n_nationkey) || '. Note: listed once.' AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "gap_chunks_every": "SELECT source, doc_id, '[Known gap]' || chr(10) || chr(10) || doc_id || ' is not classified in ' || source || '.' AS text FROM documents WHERE source IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "prompt_messages": """WITH s AS (SELECT doc_id // 3 AS query_id, string_agg('[S' || (doc_id % 3 + 1) || '] ' || concat_ws(' > ', source, lang) || ' (p.' || CASE WHEN doc_id % 4 = 0 THEN 'None' ELSE CAST(doc_id % 4 AS VARCHAR) END || ')' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id) AS b FROM documents WHERE doc_id % 3 < 2 GROUP BY 1),
      m AS (SELECT item_id AS query_id, 'SOURCES' || chr(10) || coalesce(b, '') || chr(10) || chr(10) || 'QUESTION' || chr(10) || text AS message FROM benchmark LEFT JOIN s ON s.query_id = item_id) SELECT query_id, md5(message) AS digest, length(message) AS n_chars FROM m""",
    "checked_fields": f"WITH {NAMED} SELECT 'I' || name_id || ' [' || category || ']' AS label, rate_text AS text FROM named JOIN rated ON p_name = name UNION ALL SELECT 'R' || s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0",
    "vault_roundtrip": """WITH r AS (SELECT 'district' AS entity, 'D' || n_nationkey AS id, n_name AS title, n_nationkey AS k, CAST(NULL AS VARCHAR) AS renamed FROM nation UNION ALL SELECT 'incentive', 'I' || c_custkey, c_name, c_custkey, 'open' FROM customer)
      SELECT entity, id, title, CASE k % 3 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'draft' ELSE 'stable' END AS status, renamed, 'S' || (k % 3) AS source FROM r""",
    "node_findings": f"WITH {walk_sql()}, {FINDINGS} SELECT concept_id, coalesce(string_agg(finding_id, ',' ORDER BY finding_id), '') AS finding_ids FROM nodes LEFT JOIN of_node USING (concept_id) GROUP BY concept_id",
    "evidence_full": f"""WITH {walk_sql()}, {FINDINGS}, told AS (SELECT w.query_id, w.position, n.concept_id, n.entity_type FROM walked w JOIN nodes n USING (concept_id)),
      ids AS (SELECT query_id, 'chunk' AS kind, 'k' || c_custkey AS id, position, 'a' AS part FROM told JOIN customer ON concept_id = 'nation/' || c_nationkey
        UNION ALL SELECT query_id, 'ambiguity', string_split(concept_id, '/')[2], position, 'b' FROM told WHERE entity_type = 'eligibility_rule'
        UNION ALL SELECT query_id, 'finding', finding_id, position, 'c' FROM told JOIN of_node USING (concept_id)),
      firsts AS (SELECT query_id, kind, id, min(position) AS p FROM ids GROUP BY ALL),
      agg AS (SELECT query_id, string_agg(id, ',' ORDER BY p, id) FILTER (kind = 'chunk') AS c, string_agg(id, ',' ORDER BY p, id) FILTER (kind = 'ambiguity') AS a, string_agg(id, ',' ORDER BY p, id) FILTER (kind = 'finding') AS f FROM firsts GROUP BY query_id)
      SELECT q.query_id, coalesce(c, '') AS chunk_ids, coalesce(a, '') AS ambiguity_ids, coalesce(f, '') AS finding_ids, CASE WHEN q.query_id = 4 THEN 'none/1' ELSE '' END AS missing_ids FROM (SELECT unnest(range(5)) AS query_id) q LEFT JOIN agg USING (query_id)""",
    "intent_templates": f"""SELECT item_id, CASE item_id % 3 WHEN 0 THEN CASE WHEN item_id % 2 = 1 THEN {TEMPLATE_SQL['grievance'][1]} ELSE {TEMPLATE_SQL['grievance'][0]} END WHEN 1 THEN CASE WHEN item_id % 2 = 1 THEN {TEMPLATE_SQL['calculation_request'][1]} ELSE {TEMPLATE_SQL['calculation_request'][0]} END END AS answer FROM benchmark""",
}
