"""Queries over note operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compilation as C
from ..operators import notes as N
from .graph_queries import nodes, walk_sql, walked
from .inline import frame, values
from .record_queries import NAMED, named
from .retrieval_queries import rerank_sql, reranked, stated, table

CONCEPTS = values(
    "concepts",
    "concept_id, entity_type, domain_id",
    [("schemes/a", "scheme", "CG"), ("terms/cg", "glossary_term", "CG"), ("incentives/i1", "incentive", "I1"), ("rules/r", "eligibility_rule", "R"), ("x/R2", "district", None), ("odd/z", "unknown", "R")],
)
CONCEPT_TYPES = "concept_id string, entity_type string, domain_id string"
REFERENCES = values(
    "refs",
    "ref_id, reference, base",
    [(0, "[[CG]]", None), (1, "/schemes/a.md#part", "x/y"), (2, "../incentives/i1.md", "rules/r"), (3, "./r.md", "rules/q"), (4, "https://e.org/a", None), (5, "I1", ""), (6, "nowhere", None), (7, "[[R|the rule]]", None), (8, "", None), (9, None, None), (10, "../../terms/cg", "a/b/c/d")],
)
BODIES = values("bodies", "path, body", [("n/1.md", "see [[CG]] and [[R|the rule]], not [[lost]]."), ("n/2.md", "plain"), ("m/3.md", "[[I1]][[I1|x]]"), ("m/4.md", "")])
REGISTER = values("register", "id, local_id, en, hi, severity", [("B-AMB-1", "AMB-1", "Rate unclear.", "दर अस्पष्ट।", "blocking"), ("B-AMB-2", "AMB-2", "See office.", "कार्यालय देखें।", "advisory")])
NEEDED = values("needed", "query_id, flag, language, pos", [(0, "AMB-1", "en", 1), (0, "B-AMB-1", "en", 2), (0, "B-AMB-2", "en", 3), (1, "AMB-2", "hi", 1), (2, "AMB-9", "en", 1)])
PAGE_TEXTS = values("texts", "page, text", [(1, "Intro ANNEX A  12 "), (2, "ANNEX A body"), (3, "none"), (4, "ANNEX A")])


FETCHED = values("fetched", "source_id, fetch_strategy, compliance_checked, robots", [("a", "manual", None, None), ("b", "scrape", True, "allowed"), ("c", "scrape", True, "denied"), ("d", "api", False, "allowed"), ("e", "api", None, None)])


def resolve(s, d):
    index = N.concept_index(frame(s, CONCEPTS, CONCEPT_TYPES))
    return N.resolve(frame(s, REFERENCES, "ref_id bigint, reference string, base string"), index).select("ref_id", "token", "concept_id")


def rewrite(s, d):
    return N.rewrite_wikilinks(frame(s, BODIES, "path string, body string"), N.concept_index(frame(s, CONCEPTS, CONCEPT_TYPES)))


def listing(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return N.directory_index(n.select(F.concat(F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit(".md")).alias("path"), F.col("n_name").alias("title")))


def disclosures(s, d):
    return N.disclosures(frame(s, NEEDED, "query_id bigint, flag string, language string, pos int"), frame(s, REGISTER, "id string, local_id string, en string, hi string, severity string"))


def abstain(s, d, n: int | None = 5):
    from ..operators.retrieval import suggestions

    top = suggestions(reranked(s, d, n), "source").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "source"))), lambda x: x.source), ", ").alias("said"))
    return top.select("query_id", N.abstain_message(F.when(F.col("query_id") % 2 == 1, "hi").otherwise("en"), F.col("said"), "the handbook").alias("message"))


def graph_answers(s, d):
    w = walked(s, d).join(nodes(s, d), "concept_id").withColumn("summary", F.when(F.col("entity_type") != "sector", F.concat(F.lit("about "), F.col("concept_id"))))
    return N.graph_answer(w)


def summaries(s, d):
    return named(s, d).select("name_id", N.summary(F.col("rates"), F.col("name")).alias("summary"), F.array_join(N.distinct_aliases(F.col("name"), F.upper("name"), F.initcap("name"), F.element_at(F.split("name", " "), -1)), "|").alias("aliases"))


def sources(s, d):
    o = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_returnflag").alias("id"), F.col("l_linestatus").alias("resource")))).alias("sources"))
    return o.select("l_orderkey", F.array_join(F.transform(N.distinct_sources(F.col("sources")), lambda x: F.concat(x.id, x.resource)), ",").alias("sources"))


INDEX_SQL = f"""c AS ({CONCEPTS}), ranked AS (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY coalesce(list_position([{", ".join(f"'{x}'" for x in N.PREFERENCE)}], entity_type), 99), concept_id) AS r FROM c WHERE domain_id IS NOT NULL),
  idx AS (SELECT concept_id AS token, concept_id FROM c UNION ALL SELECT domain_id, concept_id FROM ranked WHERE r = 1 AND domain_id NOT IN (SELECT concept_id FROM c))"""


def token_sql(c: str) -> str:
    """A reference without brackets, label, fragment, leading slash and suffix; NULL for external ones."""
    bare = f"regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({c}, '^\\[\\[([^\\]|]*)(\\|[^\\]]*)?\\]\\]$', '\\1')), '#.*$', ''), '^/+', ''), '\\.md$', '')"
    return f"CASE WHEN regexp_matches({c}, '://|^mailto:') THEN NULL ELSE nullif({bare}, '') END"


QUERIES = {
    "concept_resolve": resolve,
    "link_rewrite": rewrite,
    "directory_index": listing,
    "disclosure_lookup": disclosures,
    "abstain_message": abstain,
    "graph_tier_answer": graph_answers,
    "node_summaries": summaries,
    "distinct_sources": sources,
    "compliance_gate": lambda s, d: C.compliance_gaps(frame(s, FETCHED, "source_id string, fetch_strategy string, compliance_checked boolean, robots string")),
    "empty_after_heading": lambda s, d: frame(s, PAGE_TEXTS, "page int, text string").select("page", N.empty_after_heading(F.col("text"), "ANNEX A").alias("empty")),
}
SQL = {
    "concept_resolve": f"""WITH {INDEX_SQL}, n AS (SELECT ref_id, reference, base, {token_sql('reference')} AS t FROM ({REFERENCES})),
      r AS (SELECT ref_id, CASE WHEN t LIKE '.%' THEN list_reduce(list_prepend(regexp_replace(coalesce(base, ''), '(^|/)[^/]*$', ''), list_filter(string_split(t, '/'), lambda x: x NOT IN ('', '.'))),
        lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '(^|/)[^/]*$', '') WHEN acc = '' THEN x ELSE acc || '/' || x END) ELSE t END AS token FROM n)
      SELECT CAST(ref_id AS BIGINT) AS ref_id, token, concept_id FROM r LEFT JOIN idx USING (token)""",
    "link_rewrite": f"""WITH {INDEX_SQL}, parts AS (SELECT path, unnest(string_split_regex(body, '\\[\\[[^\\]]+\\]\\]')) AS text, unnest(list_append(regexp_extract_all(body, '\\[\\[[^\\]]+\\]\\]'), '')) AS link, unnest(range(len(regexp_extract_all(body, '\\[\\[[^\\]]+\\]\\]')) + 1)) AS pos FROM ({BODIES})),
      named AS (SELECT *, CASE WHEN link <> '' THEN {token_sql('link')} END AS token, nullif(trim(regexp_extract(link, '\\|([^\\]]*)\\]\\]$', 1)), '') AS label FROM parts),
      said AS (SELECT path, pos, text || CASE WHEN concept_id IS NOT NULL THEN '[' || coalesce(label, token) || '](/' || concept_id || '.md)' ELSE link END AS out FROM named LEFT JOIN idx USING (token))
      SELECT path, string_agg(out, '' ORDER BY pos) AS body FROM said GROUP BY path""",
    "directory_index": "SELECT lower(r_name) AS folder, string_agg('- [' || n_name || '](/' || lower(r_name) || '/' || lower(n_name) || '.md)', chr(10) ORDER BY n_name) AS listing, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "disclosure_lookup": f"""WITH i AS (SELECT id AS flag, id, en, hi, severity FROM ({REGISTER}) UNION ALL SELECT local_id, id, en, hi, severity FROM ({REGISTER})), f AS (SELECT CAST(query_id AS BIGINT) AS query_id, id, min(pos) AS pos, min(CASE WHEN language = 'hi' THEN hi ELSE en END) AS text, max(severity = 'blocking') AS b FROM ({NEEDED}) JOIN i USING (flag) GROUP BY ALL)
      SELECT query_id, string_agg(text, chr(10) ORDER BY pos) AS disclosures, bool_or(b) AS blocking FROM f GROUP BY query_id""",
    "abstain_message": f"""WITH {rerank_sql()}, t AS (SELECT query_id, string_agg(source, ', ' ORDER BY position) AS said FROM (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY first, source) AS position FROM (SELECT query_id, source, min(rank) AS first FROM reranked GROUP BY ALL)) WHERE position <= 3 GROUP BY query_id)
      SELECT query_id, CASE WHEN query_id % 2 = 1 THEN 'यह विषय the handbook में शामिल नहीं है। संबंधित विषय: ' || said || '।' ELSE 'This does not appear to be covered in the handbook. Related topics: ' || said || '.' END AS message FROM t""",
    "graph_tier_answer": f"""WITH {walk_sql()}, w AS (SELECT *, entity_type IN ('incentive', 'eligibility_rule', 'ambiguity_flag') AS bears FROM walked JOIN nodes USING (concept_id) WHERE entity_type <> 'sector'),
      k AS (SELECT *, bool_or(bears) OVER (PARTITION BY query_id) AS found FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS r FROM k WHERE bears OR NOT found)
      SELECT query_id, string_agg('- ' || title || ': about ' || concept_id, chr(10) ORDER BY r) AS answer, count(*) AS n FROM r WHERE r <= CASE WHEN found THEN 5 ELSE 4 END GROUP BY query_id""",
    "node_summaries": f"""WITH {NAMED} SELECT n.name_id, (SELECT left(string_agg(category || ': ' || rate_text, '; ' ORDER BY category), 400) FROM rated r WHERE r.p_name = n.name) AS summary, n.name || '|' || string_split(n.name, ' ')[-1] AS aliases FROM named n""",
    "distinct_sources": "SELECT l_orderkey, string_agg(s, ',' ORDER BY s) AS sources FROM (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS s FROM lineitem) GROUP BY l_orderkey",
    "compliance_gate": f"SELECT source_id, CASE WHEN coalesce(compliance_checked, FALSE) THEN 'robots' ELSE 'not checked' END AS reason FROM ({FETCHED}) WHERE fetch_strategy <> 'manual' AND NOT (coalesce(compliance_checked, FALSE) AND coalesce(robots, '') = 'allowed')",
    "empty_after_heading": f"SELECT CAST(page AS BIGINT) AS page, contains(text, 'ANNEX A') AND regexp_replace(list_extract(string_split(text, 'ANNEX A'), -1), '[\\s\\d]+', '', 'g') = '' AS empty FROM ({PAGE_TEXTS})",
}
QUERIES["abstain_message_every50"] = lambda s, d: abstain(s, d, None)
SQL["abstain_message_every50"] = stated(SQL["abstain_message"])
