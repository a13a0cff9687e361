"""The answer ladder over the tables, and its SQL.

Questions are benchmark items, users' turns, questions about parts and about the first sentence of documents (ids
divisible by 50), each in three modes. Records are the names of parts with rates by category, the register of open questions stands on
nations, chunks are documents, and the graph links regions, nations, suppliers and names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import compilation as C
from ..operators import facts as FA
from ..operators import graph as G
from ..operators import index as IX
from ..operators import retrieval as R
from ..sources import snapshot
from . import graph_queries as GQ
from . import record_queries as RQ
from .retrieval_queries import TOKENS, table

PRIORITY = ("incentive", "eligibility_rule", "ambiguity_flag", "sector", "scheme")
TEMPLATES = (
    "What rate does a micro unit get for the {}?",
    "how much is there for a medium {}",
    "Why is the {} capped?",
    "tell me about {} in NATION_4",
    "I have a complaint about {}",
    "please calculate my benefit for {}",
    "सूक्ष्म उद्यम के लिए कितनी सहायता {}",
)
DOCUMENT = "the documents"
THRESHOLDS = [("en", 0.5, 0.75), ("fr", 0.6, 0.9), ("default", 0.4, 0.7)]


def questions(s, d) -> DataFrame:
    """(query_id, text) of the asking side."""
    b = table(s, d, "benchmark").filter("item_id % 50 = 0").select(F.concat(F.lit("bench/"), "item_id").alias("query_id"), "text")
    t = table(s, d, "conversations").filter("conv_id % 50 = 0 and role = 'user'").select(F.concat(F.lit("talk/"), "conv_id", F.lit("/"), "turn").alias("query_id"), "text")
    kind = F.floor(F.col("p_partkey") / 50) % len(TEMPLATES)
    asked = [F.when(kind == k, F.concat(F.lit(x.split("{}")[0]), "p_name", F.lit(x.split("{}")[1]))) for k, x in enumerate(TEMPLATES)]
    p = table(s, d, "part").filter("p_partkey % 50 = 0").select(F.concat(F.lit("part/"), "p_partkey").alias("query_id"), F.coalesce(*asked).alias("text"))
    c = table(s, d, "documents").filter("doc_id % 50 = 0").select(F.concat(F.lit("cite/"), "doc_id").alias("query_id"), F.concat(F.lit("rate "), F.split_part("text", F.lit("."), F.lit(1))).alias("text"))
    return C.union_all([b, t, p, c])


def local_key(c) -> F.Column:
    return F.concat(F.lit("L"), c % 25)


def records(s, d) -> DataFrame:
    n = RQ.named(s, d)
    flags = F.when(F.col("name_id") % 2 == 0, F.array(F.concat(F.lit("AMB-"), F.col("name_id") % 25), local_key(F.col("name_id") * 3), F.lit("no such flag"))).otherwise(F.array().cast("array<string>"))
    return n.select("name_id", "name", F.lit("Catalogue").alias("path"), (F.col("name_id") % 40).cast("int").alias("page"), "rates", F.col("name").rlike("ring|bolt").alias("varies"), F.when(F.col("name_id") % 7 == 0, "rate_unstated").otherwise("stated").alias("status"), flags.alias("flags"))


def register(s, d) -> DataFrame:
    k = F.col("n_nationkey")
    return table(s, d, "nation").select(
        F.concat(F.lit("AMB-"), k).alias("id"), F.concat(F.lit("L"), k).alias("local_id"), F.when(k % 5 == 0, "missing_rate").otherwise("wording").alias("issue_type"),
        F.concat(F.lit("Open: "), "n_name", F.lit(".")).alias("en"), F.concat(F.lit("खुला: "), "n_name", F.lit("।")).alias("hi"), F.when(k % 2 == 0, "blocking").otherwise("advisory").alias("severity"),
    )


def chunks(s, d) -> DataFrame:
    i = F.col("doc_id")
    flags = F.when(i % 4 == 0, F.array(local_key(i))).otherwise(F.array().cast("array<string>"))
    entity = F.when(i % 3 == 0, F.concat(F.lit("nation/"), i % 25))
    return table(s, d, "documents").select("doc_id", "text", F.col("source").alias("path"), F.col("n_chars").cast("int").alias("page"), F.col("lang").alias("document"), F.col("source").alias("section"), flags.alias("flags"), entity.alias("entity"))


def nodes(s, d) -> DataFrame:
    none, no_text = F.array().cast("array<long>"), F.array().cast("array<string>")
    r = table(s, d, "region").select(F.concat(F.lit("region/"), "r_regionkey").alias("concept_id"), F.lit("scheme").alias("entity_type"), F.col("r_name").alias("title"), F.lit("human-reviewed").alias("trust"), F.lit(None).cast("string").alias("domain_id"), none.alias("chunk_ids"), no_text.alias("missing"))
    nk, sk, pk = F.col("n_nationkey"), F.col("s_suppkey"), F.col("name_id")
    n = table(s, d, "nation").select(F.concat(F.lit("nation/"), nk).alias("concept_id"), F.lit("sector").alias("entity_type"), F.col("n_name").alias("title"), F.lit("human-reviewed").alias("trust"), F.lit(None).cast("string").alias("domain_id"), none.alias("chunk_ids"), F.when(nk % 6 == 4, F.array(F.concat(F.lit("rate in "), "n_name"))).otherwise(no_text).alias("missing"))
    p = table(s, d, "supplier").select(F.concat(F.lit("supplier/"), sk).alias("concept_id"), F.when(sk % 5 == 0, "ambiguity_flag").otherwise("eligibility_rule").alias("entity_type"), F.col("s_name").alias("title"), F.lit("unverified").alias("trust"), local_key(sk).alias("domain_id"), F.array(sk.cast("long")).alias("chunk_ids"), no_text.alias("missing"))
    i = RQ.named(s, d).select(F.concat(F.lit("part/"), pk).alias("concept_id"), F.lit("incentive").alias("entity_type"), F.col("name").alias("title"), F.when(pk % 3 == 0, "unverified").otherwise("machine-confirmed").alias("trust"), F.lit(None).cast("string").alias("domain_id"), F.array(pk.cast("long"), (pk + 1).cast("long")).alias("chunk_ids"), no_text.alias("missing"))
    every = C.union_all([r, n, p, i])
    return every.withColumn("summary", F.when(F.col("entity_type") != "sector", F.concat("title", F.lit(" is of type "), "entity_type")))


def edges(s, d) -> DataFrame:
    name = RQ.named(s, d).select(F.concat(F.lit("part/"), "name_id").alias("src"), "name_id")
    more = C.union_all([name.select("src", F.concat(F.lit("nation/"), F.col("name_id") % 25).alias("dst"), F.lit("scoped_to_sector").alias("kind")), name.select("src", F.concat(F.lit("supplier/"), F.col("name_id") % 100).alias("dst"), F.lit("governed_by").alias("kind"))])
    return G.typed_edges(GQ.refs(s, d).filter("src not like 'customer/%'").unionByName(more), GQ.WEIGHTS)


def knowledge(s, d) -> A.Knowledge:
    c, n, e = chunks(s, d), nodes(s, d), edges(s, d)
    aliases = G.alias_table(n.filter("entity_type in ('scheme', 'sector', 'incentive')").select("concept_id", F.array("title").alias("aliases")))

    def retrieve(asked: DataFrame) -> DataFrame:
        found = R.sparse_search(c.select("doc_id", "text"), asked).filter(F.col("rank") <= R.SHORTLIST).select("query_id", "doc_id")
        pairs = R.lexical_pairs(found, asked, c.select("doc_id", "text", F.col("document").alias("source_type")))
        return R.rerank(pairs, logit=F.col("logit")).drop("logit")

    def walk(asked: DataFrame, seeds: DataFrame) -> DataFrame:
        return G.walk(n, e, G.held(G.entry_points(asked, aliases, seeds)), G.WalkConfig(type_priority=PRIORITY), many=True).select("query_id", "concept_id", "score", "position")

    return A.Knowledge(records(s, d), register(s, d), retrieve, c, n, walk, s.createDataFrame(THRESHOLDS, "source_type string, tau_hard double, tau_soft double"), DOCUMENT)


def requests(s, d) -> DataFrame:
    names = RQ.named(s, d).select("name_id", "name")
    u = FA.understand(G.held(questions(s, d)), names)
    u = u.withColumn("mode", F.explode(F.array(*map(F.lit, (A.RAG, A.RECORDS, A.BOTH)))))
    return u.withColumn("request_id", F.concat_ws("|", "query_id", "mode"))


def ladder_answers(s, d) -> DataFrame:
    return A.answer(requests(s, d), knowledge(s, d)).drop("request_id")


def index_search(s, d) -> DataFrame:
    """The questions against the persistent index of all documents."""
    folder = snapshot.scratch(s)
    IX.build(table(s, d, "documents").select("doc_id", "text"), folder)
    return IX.search(s, folder, R.postings(questions(s, d), "query_id"))[0]


QUERIES = {"ladder_answers": ladder_answers, "index_search_top30": index_search}

# --- SQL

q, figures_sql, when_sql = RQ.q, RQ.figures_sql, RQ.when_sql
ASKED = f"""q AS (SELECT 'bench/' || item_id AS query_id, text FROM benchmark WHERE item_id % 50 = 0 UNION ALL SELECT 'talk/' || conv_id || '/' || turn, text FROM conversations WHERE conv_id % 50 = 0 AND role = 'user'
  UNION ALL SELECT 'part/' || p_partkey, CASE p_partkey // 50 % {len(TEMPLATES)} {" ".join(f"WHEN {k} THEN {q(x.split('{}')[0])} || p_name || {q(x.split('{}')[1])}" for k, x in enumerate(TEMPLATES))} END FROM part WHERE p_partkey % 50 = 0
  UNION ALL SELECT 'cite/' || doc_id, 'rate ' || split_part(text, '.', 1) FROM documents WHERE doc_id % 50 = 0)"""
RECORDS_SQL = """rec AS (SELECT name_id, name, name_id % 40 AS page, regexp_matches(name, 'ring|bolt') AS varies, name_id % 7 = 0 AS unstated,
    CASE WHEN name_id % 2 = 0 THEN ['AMB-' || (name_id % 25), 'L' || (name_id * 3 % 25), 'no such flag'] ELSE [] END AS flags FROM named),
  reg AS (SELECT 'AMB-' || n_nationkey AS id, 'L' || n_nationkey AS local_id, n_nationkey % 5 = 0 AS gap, 'Open: ' || n_name || '.' AS en, 'खुला: ' || n_name || '।' AS hi FROM nation),
  amb AS (SELECT name_id, list({'l': local_id, 'g': gap, 'en': en, 'hi': hi} ORDER BY pos) AS amb FROM (SELECT name_id, unnest(flags) AS flag, generate_subscripts(flags, 1) AS pos FROM rec) f JOIN reg ON flag IN (id, local_id) GROUP BY name_id)"""
RETRIEVED = f"""sparse AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT k.query_id, p.doc_id, CAST(sum(p.tf * k.tf) AS DOUBLE) AS score FROM (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS t FROM documents) GROUP BY ALL) p
    JOIN (SELECT query_id, t, count(*) AS tf FROM (SELECT query_id, unnest({TOKENS}) AS t FROM q) GROUP BY ALL) k USING (t) GROUP BY ALL)) WHERE rank <= 12),
  reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT c.query_id, d.doc_id, d.lang, d.source, d.n_chars, d.text,
      round(1 / (1 + exp(-(8e0 * len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+')), regexp_extract_all(lower(d.text), '[a-z0-9]+'))) / greatest(len(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+'))), 1) - 4))), 6) AS score
    FROM sparse c JOIN documents d USING (doc_id) JOIN q USING (query_id)))"""
GATED = f"""thresholds AS (SELECT * FROM (VALUES {", ".join(f"('{k}', CAST({h} AS DOUBLE), CAST({x} AS DOUBLE))" for k, h, x in THRESHOLDS)}) AS t(lang, h, s)),
  limits AS (SELECT q.query_id, coalesce(r.score, 0e0) AS score, coalesce(t.h, x.h) AS h, coalesce(t.s, x.s) AS s FROM q LEFT JOIN (SELECT * FROM reranked WHERE rank = 1) r USING (query_id) LEFT JOIN thresholds t ON t.lang = r.lang, (SELECT h, s FROM thresholds WHERE lang = 'default') x),
  gate AS (SELECT query_id, CASE WHEN score < h THEN 'abstain' WHEN score < s THEN 'answer_low_confidence' ELSE 'answer' END AS action FROM limits)"""
GRAPH = (
    """nodes AS (SELECT 'region/' || r_regionkey AS concept_id, 'scheme' AS entity_type, r_name AS title, TRUE AS ok, NULL AS domain_id, CAST([] AS BIGINT[]) AS chunk_ids, CAST([] AS VARCHAR[]) AS missing FROM region
  UNION ALL SELECT 'nation/' || n_nationkey, 'sector', n_name, TRUE, NULL, [], CASE WHEN n_nationkey % 6 = 4 THEN ['rate in ' || n_name] ELSE [] END FROM nation
  UNION ALL SELECT 'supplier/' || s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'ambiguity_flag' ELSE 'eligibility_rule' END, s_name, FALSE, 'L' || (s_suppkey % 25), [s_suppkey], [] FROM supplier
  UNION ALL SELECT 'part/' || name_id, 'incentive', name, name_id % 3 <> 0, NULL, [name_id, name_id + 1], [] FROM named)""",
    """edges AS (SELECT DISTINCT src, dst, kind, CASE kind WHEN 'in_scheme' THEN 0.4e0 WHEN 'scoped_to_sector' THEN 0.8e0 ELSE 1e0 END AS w FROM (SELECT 'nation/' || n_nationkey AS src, 'region/' || n_regionkey AS dst, 'in_scheme' AS kind FROM nation
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'governed_by' FROM supplier UNION ALL SELECT 'part/' || name_id, 'nation/' || (name_id % 25), 'scoped_to_sector' FROM named UNION ALL SELECT 'part/' || name_id, 'supplier/' || (name_id % 100), 'governed_by' FROM named))""",
    f"""alias AS (SELECT DISTINCT concept_id, array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') AS alias FROM nodes WHERE entity_type IN ('scheme', 'sector', 'incentive')),
  usable AS (SELECT * FROM alias WHERE length(alias) >= 4 AND len(list_filter(string_split(alias, ' '), lambda w: w NOT IN ({", ".join(map(q, G.STOPWORDS))}))) > 0)""",
    """seeds AS (SELECT query_id || '|records_rag' AS query_id, 'nation/' || (doc_id % 25) AS concept_id, min(rank) AS pos FROM reranked JOIN todo USING (query_id) WHERE mode = 'records_rag' AND rank <= 6 AND doc_id % 3 = 0 GROUP BY ALL)""",
    """hits AS (SELECT r.request_id AS query_id, u.concept_id, min((1, -length(alias), alias)) AS o FROM todo r JOIN usable u ON contains(' ' || array_to_string(regexp_extract_all(lower(r.text), '[a-z0-9]+'), ' ') || ' ', ' ' || u.alias || ' ') WHERE r.mode <> 'rag' GROUP BY ALL
    UNION ALL SELECT query_id, concept_id, (0, CAST(pos AS INTEGER), '') FROM seeds)""",
    "entries AS (SELECT query_id, concept_id, row_number() OVER (PARTITION BY query_id ORDER BY o, concept_id) AS pos FROM (SELECT query_id, concept_id, min(o) AS o FROM hits GROUP BY ALL))",
)
ORIGIN = lambda o: f"{{'id': CAST(doc_id AS VARCHAR), 'path': source, 'page': CAST(coalesce(n_chars, 0) AS INTEGER), 'text': text, 'origin': '{o}'}}"
LISTS = "list_reduce(list_transform({0}, lambda v: [v]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END, CAST([] AS VARCHAR[]))"


def unique(x: str) -> str:
    return LISTS.format(x)


def quote_sql(src: str, document: str) -> str:
    where = f"' (' || coalesce({src}.path, '') || CASE WHEN {src}.page > 0 THEN ', p.' || {src}.page ELSE '' END || '): ' || regexp_replace({src}.text, '(?s)^\\[.*?\\]\\n\\n', '') || ' [S1]'"
    return f"CASE WHEN lang = 'hi' THEN coalesce({document} || ' के अनुसार', 'प्रारूप नीति के अनुसार') ELSE coalesce('According to ' || {document}, 'According to the draft policy') END || {where}"


TAGS = lambda x: f"array_to_string(list_transform({x}, lambda s, i: 'S' || i || ':' || s.id || '@' || s.origin), ' ')"
FIXED = "CASE intent " + " ".join(f"WHEN {q(k)} THEN CASE WHEN lang = 'hi' THEN {q(hi)} ELSE {q(en)} END" for k, (en, hi) in A.N.TEMPLATES.items()) + f" WHEN 'greeting' THEN CASE WHEN lang = 'hi' THEN {q(f'नमस्ते! {DOCUMENT} के बारे में पूछें।')} ELSE {q(f'Hello! Ask a question about {DOCUMENT}.')} END END"
STRUCT = "STRUCT(id VARCHAR, path VARCHAR, page INTEGER, text VARCHAR, origin VARCHAR)[]"
SQL = {
    "index_search_top30": f"""WITH {ASKED} SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT k.query_id, p.doc_id, CAST(sum(p.tf * k.tf) AS DOUBLE) AS score FROM (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS t FROM documents) GROUP BY ALL) p
    JOIN (SELECT query_id, t, count(*) AS tf FROM (SELECT query_id, unnest({TOKENS}) AS t FROM q) GROUP BY ALL) k USING (t) GROUP BY ALL)) WHERE rank <= 30""",
    "ladder_answers": f"""WITH {ASKED}, {RQ.NAMED}, {RECORDS_SQL},
  words AS (SELECT name_id, list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z]+'), lambda w: w NOT IN ({RQ.STOP}))) AS ws FROM named),
  m AS (SELECT query_id, count(*) AS n, any_value(name_id) AS name_id FROM q JOIN words w ON len(ws) > 0 AND len(list_filter(ws, lambda x: NOT list_contains(regexp_extract_all(lower(q.text), '[a-z]+'), x))) = 0 GROUP BY query_id),
  base AS (SELECT q.query_id, text, CASE WHEN {RQ.LANGUAGE} = 'hi' THEN 'hi' ELSE 'en' END AS lang, {when_sql("text", T.INTENTS, "'policy_qa'")} AS intent, {when_sql("text", T.CATEGORIES, "NULL")} AS cat, m.n, m.name_id FROM q LEFT JOIN m USING (query_id)),
  routed AS (SELECT query_id, text, lang, intent, CASE WHEN ok THEN cat END AS category, CASE WHEN ok AND n = 1 THEN name_id END AS name_id,
    CASE WHEN NOT ok THEN 'rag_narrative' WHEN regexp_matches(text, {q(T.EXPLANATORY)}) THEN 'hybrid' WHEN cat IS NOT NULL AND regexp_matches(text, {q(T.LOOKUP)}) THEN 'record_lookup' ELSE 'hybrid' END AS route FROM (SELECT *, intent = 'policy_qa' AND n IS NOT NULL AS ok FROM base)),
  req AS (SELECT r.query_id || '|' || mode AS request_id, r.query_id, mode, r.text, lang, intent, r.category, CASE WHEN mode = 'rag' THEN 'rag_narrative' ELSE route END AS route, r.name_id, rec.name, rec.page, rec.varies, rec.unstated, coalesce(amb, []) AS amb,
      rated.rate_text AS rate, CASE WHEN r.category IS NULL AND NOT rec.varies THEN f.rate_text END AS any_rate, f.category AS any_cat
    FROM routed r CROSS JOIN (VALUES ('rag'), ('records'), ('records_rag')) AS modes(mode) LEFT JOIN rec ON rec.name_id = r.name_id LEFT JOIN amb ON amb.name_id = r.name_id LEFT JOIN rated ON rated.p_name = rec.name AND rated.category = r.category
    LEFT JOIN (SELECT p_name, category, rate_text FROM rated QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY category) = 1) f ON f.p_name = rec.name),
  looked AS (SELECT *, CASE WHEN unstated AND len(list_filter(amb, lambda a: a.g)) > 0 THEN CASE WHEN lang = 'hi' THEN list_filter(amb, lambda a: a.g)[1].hi ELSE list_filter(amb, lambda a: a.g)[1].en END || ' [S1]'
      ELSE CASE WHEN lang = 'hi' THEN name || ' (' || category || ' उद्यम के लिए): ' || rate || '। [S1]' ELSE name || ' for a ' || category || ' enterprise: ' || rate || '. [S1]' END
        || CASE WHEN len(amb) > 0 THEN chr(10) || chr(10) || array_to_string(list_transform(amb, lambda a: CASE WHEN lang = 'hi' THEN a.hi ELSE a.en END), chr(10)) ELSE '' END END AS answer
    FROM req WHERE intent NOT IN ('greeting', 'grievance') AND route = 'record_lookup' AND category IS NOT NULL AND rate IS NOT NULL),
  todo AS (SELECT * FROM req WHERE intent NOT IN ('greeting', 'grievance') AND request_id NOT IN (SELECT request_id FROM looked)),
  {RETRIEVED}, {GATED}, led AS (SELECT query_id, rank, score, lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS next FROM reranked),
  {GQ.walk_sql(given=GRAPH, priority=PRIORITY)},
  told AS (SELECT w.query_id AS request_id, w.position, n.*, CASE WHEN entity_type <> 'sector' THEN title || ' is of type ' || entity_type END AS summary FROM walked w JOIN nodes n USING (concept_id)),
  parts0 AS (SELECT request_id, count(*) AS n, count(*) FILTER (ok) AS trusted, list(list_transform(chunk_ids, lambda x: CAST(x AS VARCHAR)) ORDER BY position) AS cs, list(domain_id ORDER BY position) FILTER (entity_type = 'ambiguity_flag') AS fs, list(missing ORDER BY position) AS ms,
    list({{'t': title, 's': summary, 'c': chunk_ids}} ORDER BY position) FILTER (summary IS NOT NULL AND entity_type IN ('incentive', 'eligibility_rule', 'ambiguity_flag'))[:5] AS bears, list({{'t': title, 's': summary, 'c': chunk_ids}} ORDER BY position) FILTER (summary IS NOT NULL)[:4] AS anys FROM told GROUP BY request_id),
  parts AS (SELECT request_id, n, trusted, {unique('flatten(cs)')} AS graph_chunks, {unique("coalesce(fs, [])")} AS graph_flags, {unique('flatten(ms)')} AS gaps, bears, anys FROM parts0),
  chosen AS (SELECT *, CASE WHEN len(bears) > 0 THEN bears ELSE coalesce(anys, []) END AS lines FROM parts),
  known AS (SELECT request_id, {unique("flatten(list_transform(lines, lambda x: list_transform(x.c, lambda y: CAST(y AS VARCHAR))))")} AS cited, graph_chunks FROM chosen),
  cited AS (SELECT request_id, list({ORIGIN('graph')} ORDER BY pos) AS cited_sources FROM (SELECT request_id, unnest(cited) AS id, generate_subscripts(cited, 1) AS pos FROM known) k JOIN documents ON doc_id = CAST(id AS BIGINT) GROUP BY request_id),
  graphed AS (SELECT request_id, list({ORIGIN('graph')} ORDER BY pos) AS graph_sources FROM (SELECT request_id, unnest(graph_chunks) AS id, generate_subscripts(graph_chunks, 1) AS pos FROM known) k JOIN documents ON doc_id = CAST(id AS BIGINT) GROUP BY request_id),
  tops0 AS (SELECT query_id, list({ORIGIN('vector')} ORDER BY CASE WHEN rank = 1 THEN 0 ELSE 1 END, coalesce(n_chars, 0), coalesce(source, ''), doc_id) AS top, list('L' || (doc_id % 25) ORDER BY rank) FILTER (doc_id % 4 = 0) AS fs,
    list({ORIGIN('vector')} ORDER BY rank) AS quotes, list(lang ORDER BY rank) AS langs, list(doc_id ORDER BY rank) AS ids FROM reranked WHERE rank <= 6 GROUP BY query_id),
  tops AS (SELECT query_id, top, {unique("coalesce(fs, [])")} AS top_flags, quotes[1] AS quote, langs[1] AS quote_document, CASE WHEN ids[1] % 4 = 0 THEN ['L' || (ids[1] % 25)] ELSE [] END AS quote_flags FROM tops0),
  topics AS (SELECT query_id, string_agg(source, ', ' ORDER BY first, source) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, source) AS k FROM (SELECT query_id, source, min(rank) AS first FROM reranked GROUP BY ALL)) WHERE k <= 3 GROUP BY query_id),
  weighed AS (SELECT t.*, CASE WHEN mode <> 'records' THEN g.action WHEN coalesce(c.n, 0) = 0 THEN 'abstain' WHEN trusted = 0 THEN 'answer_low_confidence' ELSE 'answer' END AS gate,
      g.action = 'answer' AND l.score IS NOT NULL AND (l.next IS NULL OR round(l.score - l.next, 6) > 0.15) AS dominant, coalesce(trusted, 0) AS trusted, coalesce(lines, []) AS lines, coalesce(graph_flags, []) AS graph_flags, coalesce(gaps, []) AS gaps,
      coalesce(cited_sources, CAST([] AS {STRUCT})) AS cited_sources, CASE WHEN mode = 'rag' THEN CAST([] AS {STRUCT}) ELSE coalesce(graph_sources, CAST([] AS {STRUCT})) END AS graph_sources, coalesce(top, CAST([] AS {STRUCT})) AS top, coalesce(top_flags, []) AS top_flags, quote, quote_document, quote_flags, coalesce(topics, '') AS topics
    FROM todo t LEFT JOIN gate g USING (query_id) LEFT JOIN led l ON l.query_id = t.query_id AND l.rank = 1 LEFT JOIN chosen c USING (request_id) LEFT JOIN cited USING (request_id) LEFT JOIN graphed USING (request_id) LEFT JOIN tops ON tops.query_id = t.query_id LEFT JOIN topics ON topics.query_id = t.query_id),
  tiered AS (SELECT *, CASE WHEN gate = 'abstain' AND mode <> 'rag' AND trusted >= 2 AND len(lines) > 0 AND len(cited_sources) > 0 THEN 'graph' WHEN gate = 'abstain' THEN 'abstain'
    WHEN mode <> 'records' AND intent = 'policy_qa' AND regexp_matches(text, {q(T.LOOKUP)}) AND dominant AND quote IS NOT NULL THEN 'extractive' ELSE 'synthesis' END AS tier FROM weighed),
  syn0 AS (SELECT *, mode <> 'rag' AND route = 'hybrid' AND coalesce(rate, any_rate) IS NOT NULL AS inject, CASE WHEN mode = 'records' THEN graph_sources[:6] ELSE top END AS own FROM tiered WHERE tier = 'synthesis'),
  syn1 AS (SELECT *, list_concat(CASE WHEN inject THEN [{{'id': 'record/' || name_id, 'path': 'Catalogue > ' || name || ' > ' || CASE coalesce(category, any_cat) WHEN 'micro' THEN 'Micro' WHEN 'small' THEN 'Small' ELSE 'Medium' END, 'page': CAST(page AS INTEGER), 'text': coalesce(rate, any_rate), 'origin': 'record'}}] ELSE CAST([] AS {STRUCT}) END, own,
      list_filter(graph_sources, lambda s: NOT list_contains(list_transform(own, lambda o: o.id), s.id)), CASE WHEN mode <> 'rag' AND len(gaps) > 0 THEN [{{'id': 'gap', 'path': 'graph traversal > known gap', 'page': CAST(0 AS INTEGER), 'text': array_to_string(gaps, '; '), 'origin': 'graph'}}] ELSE CAST([] AS {STRUCT}) END) AS shown,
      {unique("list_concat(CASE WHEN mode = 'records' THEN CAST([] AS VARCHAR[]) ELSE top_flags END, CASE WHEN inject THEN list_transform(amb, lambda a: a.l) ELSE CAST([] AS VARCHAR[]) END, CASE WHEN mode = 'rag' THEN CAST([] AS VARCHAR[]) ELSE graph_flags END)")} AS said FROM syn0),
  syn2 AS (SELECT *, CASE WHEN len(shown) > 0 THEN shown[1].text || ' [S1]' ELSE '' END AS draft, array_to_string(list_transform(shown, lambda s: s.text), chr(10)) AS context FROM syn1),
  syn3 AS (SELECT *, CASE WHEN len(shown) > 0 AND (len(list_filter(fd, lambda f: NOT list_contains(fc, f))) > 0 OR len(list_filter(regexp_extract_all(draft, '\\[S(\\d+)\\]', 1), lambda n: CAST(n AS INTEGER) < 1 OR CAST(n AS INTEGER) > len(shown))) > 0) THEN {quote_sql('coalesce(quote, shown[1])', q(DOCUMENT))} ELSE draft END AS body
    FROM (SELECT *, {figures_sql('draft')} AS fd, {figures_sql('context')} AS fc FROM syn2)),
  syn4 AS (SELECT *, CASE WHEN regexp_matches(lower(body), {q('|'.join(T.DISCLOSURE_WORDS))}) THEN [] ELSE list_filter(said, lambda i: NOT contains(lower(body), lower(i))) END AS silent FROM syn3),
  notes AS (SELECT request_id, string_agg(CASE WHEN lang = 'hi' THEN hi ELSE en END, chr(10) ORDER BY pos) AS note FROM (SELECT request_id, lang, id, any_value(en) AS en, any_value(hi) AS hi, min(list_position(said, flag)) AS pos FROM (SELECT request_id, lang, said, unnest(silent) AS flag FROM syn4) s JOIN reg ON flag IN (id, local_id) GROUP BY ALL) GROUP BY request_id)
  SELECT query_id, mode, intent AS tier, NULL AS gate, lang AS language, {FIXED} AS answer, '' AS sources, '' AS ambiguity_ids, FALSE AS low_confidence, FALSE AS cached FROM req WHERE intent IN ('greeting', 'grievance')
  UNION ALL SELECT query_id, mode, 'record_lookup', NULL, lang, answer, 'S1:record/' || name_id || '@record', array_to_string(list_transform(amb, lambda a: a.l), ','), FALSE, TRUE FROM looked
  UNION ALL SELECT query_id, mode, tier, gate, lang, array_to_string(list_transform(lines, lambda x: '- ' || x.t || ': ' || x.s), chr(10)) || chr(10) || chr(10) || array_to_string(list_transform(cited_sources, lambda s, i: '[S' || i || ']'), ' ') || CASE WHEN len(gaps) > 0 THEN CASE WHEN lang = 'hi' THEN chr(10) || chr(10) || 'दस्तावेज़ों से निर्धारित नहीं: ' ELSE chr(10) || chr(10) || 'Not determined by the documents: ' END || array_to_string(gaps, '; ') ELSE '' END, {TAGS('cited_sources')}, array_to_string(graph_flags, ','), FALSE, TRUE FROM tiered WHERE tier = 'graph'
  UNION ALL SELECT query_id, mode, tier, gate, lang, CASE WHEN lang = 'hi' THEN 'यह विषय {DOCUMENT} में शामिल नहीं है। संबंधित विषय: ' || CASE WHEN mode = 'records' THEN '' ELSE topics END || '।' ELSE 'This does not appear to be covered in {DOCUMENT}. Related topics: ' || CASE WHEN mode = 'records' THEN '' ELSE topics END || '.' END, '', '', FALSE, FALSE FROM tiered WHERE tier = 'abstain'
  UNION ALL SELECT query_id, mode, tier, gate, lang, {quote_sql('quote', 'quote_document')}, 'S1:' || quote.id || '@vector', array_to_string(quote_flags, ','), gate = 'answer_low_confidence', TRUE FROM tiered WHERE tier = 'extractive'
  UNION ALL SELECT query_id, mode, tier, gate, lang, body || coalesce(chr(10) || chr(10) || note, '') || CASE WHEN intent = 'calculation_request' THEN chr(10) || chr(10) || {FIXED} ELSE '' END, {TAGS('shown')}, array_to_string(said, ','), gate = 'answer_low_confidence', TRUE FROM syn4 LEFT JOIN notes USING (request_id)""",
}

