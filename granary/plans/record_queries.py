"""Queries over compilation, text, guard, routing, chunk and ladder operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as K
from ..operators import compilation as C
from ..operators import facts as FA
from ..operators import guards as U
from ..operators import ladder as L
from ..sources.records import join_spans
from .inline import ANSWER_TYPES, ANSWERS, FACTS, LINKS, NAMES, PAGES, QUESTION_TYPES, QUESTIONS, REQUIRED, frame, values
from .retrieval_queries import DENSE, FUSED, dense, hybrid, sparse_sql, stated, table


def joined(c, sep: str = "|"):
    return F.array_join(c, sep)


def questions(s) -> DataFrame:
    return frame(s, QUESTIONS, QUESTION_TYPES)


def answers(s) -> DataFrame:
    return frame(s, ANSWERS, ANSWER_TYPES)


# --- compilation


def contradiction_groups(s, d):
    return C.contradictions(table(s, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag", "flags")


def definition_conflicts(s, d):
    docs = table(s, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("term"), "source")
    return C.contradictions(docs, ["term"], "source", "sources")


def completeness_gaps(s, d):
    docs = table(s, d, "documents").select("source", "doc_id")
    return C.missing_members(docs, docs.join(table(s, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi"), "source", "doc_id")


def rate_completeness(s, d):
    return C.too_few(table(s, d, "lineitem"), "l_partkey", "l_suppkey", 20)


def ref_integrity(s, d):
    docs = C.dangling(table(s, d, "documents").select("doc_id"), table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
    items = C.dangling(table(s, d, "lineitem").select("l_partkey"), table(s, d, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")
    return docs.select(F.lit("documents.embedding").alias("field"), F.col("doc_id").alias("missing")).unionByName(items.select(F.lit("lineitem.part").alias("field"), F.col("l_partkey").alias("missing")))


HREF = 'href="/([^"#?]*)"'


def broken_links(s, d):
    targets = table(s, d, "pages").select("page_id", F.explode(T.all_matches(F.col("html"), HREF, 1)).alias("target")).distinct().withColumn("word", F.lower("target"))
    words = table(s, d, "benchmark").select(F.explode(T.all_matches(F.lower("text"), r"[^\s.,]+")).alias("word"))
    return C.dangling(targets, words, "word").select("page_id", "target")


def link_extract(s, d):
    notes = frame(s, LINKS, "note_id bigint, body string")
    links = F.transform(T.markdown_links(F.col("body")), lambda x: F.concat(x.label, F.lit(">"), x.target))
    return notes.select("note_id", joined(links).alias("links"), joined(T.wikilinks(F.col("body"))).alias("wikilinks"), joined(T.footnotes(F.col("body"))).alias("footnotes"))


def page_links(s, d):
    found = T.all_matches(F.col("html"), HREF, 1)
    return table(s, d, "pages").select("page_id", F.size(found).cast("long").alias("n_links"), joined(F.array_distinct(found), ",").alias("targets"))


def figure_crosscheck(s, d):
    return C.figure_crosscheck(frame(s, FACTS, "fact_id bigint, figure string, page int"), frame(s, PAGES, "page int, text string"))


def required_values(s, d):
    return C.required_values(frame(s, PAGES, "page int, text string"), frame(s, REQUIRED, "value string, first int, last int"))


def parity_diff(s, d):
    old = table(s, d, "documents").select("doc_id", "lang", "source", "n_chars")
    new = old.filter("n_chars <= 6000").withColumns({"lang": F.when(F.col("lang") == "fr", "FR").otherwise(F.col("lang")), "source": F.when(F.col("n_chars") < 300, "short").otherwise(F.col("source"))})
    new = new.unionByName(table(s, d, "benchmark").select((-F.col("item_id") - 1).alias("doc_id"), F.lit("en").alias("lang"), F.lit("bench").alias("source"), F.length("text").cast("long").alias("n_chars")))
    return C.parity(old, new, "doc_id", ["lang", "source", "n_chars"])


def dup_texts(s, d):
    return C.duplicates(table(s, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_hash")), "text_hash")


def regen_hash(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    again = docs.withColumn("text", T.collapse(F.col("text")))
    return C.same_hash(docs, again, "doc_id", "text")


def set_ops(s, d):
    return C.set_report(table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id"), "doc_id")


def cardinalities(s, d):
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels"]
    return C.union_all([table(s, d, n).agg(F.count("*").alias("n_rows")).withColumn("name", F.lit(n)) for n in names])


EXISTING = values("existing", "path, generated_by", [("a.md", "compile"), ("b.md", "compile"), ("c.md", None), ("d.md", "author"), ("e.md", "compile")])
WRITING = values("writing", "path", [("a.md",), ("f.md",), ("c.md",)])


def stale_rows(s, d):
    return C.stale_generated(frame(s, EXISTING, "path string, generated_by string"), frame(s, WRITING, "path string"), "compile").select("path", "generated_by")


# --- text


def figure_extract(s, d):
    a = answers(s).select(F.concat(F.lit("answer/"), F.col("answer_id")).alias("id"), F.col("answer").alias("text"))
    docs = table(s, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("id"), "text")
    return a.unionByName(docs).select("id", joined(T.figures(F.col("text"))).alias("figures"))


def spoken(s, d) -> DataFrame:
    c = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("query_id"), "text")
    return questions(s).unionByName(c)


def detect_language(s, d):
    return spoken(s, d).select("query_id", T.detect_language(F.col("text")).alias("language"), T.answer_language(T.detect_language(F.col("text"))).alias("answers_in"))


def classify_intent(s, d):
    t = F.col("text")
    return spoken(s, d).select("query_id", T.classify_intent(t).alias("intent"), T.detect_category(t).alias("category"), T.is_explanatory(t).alias("explanatory"), T.is_lookup(t).alias("lookup"))


def slug_ids(s, d):
    n = table(s, d, "part").select(F.col("p_name").alias("name")).distinct().unionByName(frame(s, NAMES, "name string"))
    c = F.col("name")
    return n.select("name", T.slug_upper(c).alias("upper"), T.slug_lower(c).alias("lower"), T.slug_id(c).alias("id"), T.slug_name(c).alias("snake"), T.chunk_id(F.lit("SCHEME"), F.lit("v1.0"), c).alias("chunk_id"), T.local_id(F.lit("SCHEME"), c).alias("local"))


def trust_tier(s, d):
    by = F.array_compact(F.array(F.when(F.col("quality") == 1, "process:check"), F.when(F.col("toxic") == 1, "human:reader")))
    return table(s, d, "labels").select("doc_id", T.trust_tier(by).alias("trust"), T.lifecycle(F.when(F.col("quality") == 1, "verified").when(F.col("toxic") == 1, "disputed").otherwise("superseded")).alias("status"))


def one_line(s, d):
    return table(s, d, "documents").select("doc_id", T.one_line(F.col("text")).alias("description"))


VERIFIERS = values("verifiers", "id, by_text", [(0, "run of verify_policy_data"), (1, "verify_chunks and verify_policy_data"), (2, "Someone Else, by hand!"), (3, ""), (4, None), (5, "***")])
ACTORS = (("(?i)verify_policy_data", "process:verify_policy_data"), ("(?i)verify_chunks", "process:verify_chunks"))


def verifier_actors(s, d):
    return frame(s, VERIFIERS, "id bigint, by_text string").select("id", joined(T.actors_of(F.col("by_text"), ACTORS)).alias("actors"))


# --- guards


def numeric_guard(s, d):
    a, c = F.col("answer"), F.col("context")
    return answers(s).select("answer_id", joined(F.array_sort(U.leaked_figures(a, c))).alias("leaked"), joined(F.array_sort(U.leaked_figures(a, c, compat=True))).alias("leaked_compat"))


def citation_guard(s, d):
    bad = F.transform(U.invalid_citations(F.col("answer"), F.col("sources")), lambda n: n.cast("string"))
    return answers(s).select("answer_id", joined(bad).alias("invalid"))


def consistency_guard(s, d):
    return answers(s).select("answer_id", joined(F.array_sort(U.mismatched_figures(F.col("answer"), F.col("truth")))).alias("mismatched"))


def disclosure_guard(s, d):
    ids = F.when(F.col("ids") == "", F.array().cast("array<string>")).otherwise(F.split("ids", ","))
    return answers(s).select("answer_id", joined(U.undisclosed(F.col("answer"), ids), ",").alias("missing"))


# --- routing, facts, chunks, ladder


def named(s, d) -> DataFrame:
    """Names with rates by category, from parts."""
    p = table(s, d, "part").select("p_name", "p_partkey", "p_brand", F.when(F.col("p_size") < 17, "micro").when(F.col("p_size") < 34, "small").otherwise("medium").alias("category"))
    rates = p.groupBy("p_name", "category").agg(F.min("p_brand").alias("rate_text"), F.min("p_partkey").alias("k"))
    return rates.groupBy("p_name").agg(F.min("k").alias("name_id"), F.array_sort(F.collect_list(F.struct("category", "rate_text"))).alias("rates")).select("name_id", F.col("p_name").alias("name"), "rates")


def understood(s, d) -> DataFrame:
    return FA.understand(questions(s), named(s, d).select("name_id", "name"))


def route(s, d):
    return understood(s, d).select("query_id", "language", "intent", "category", "matches", "n_matches", "retrieval_mode")


def structured_lookup(s, d):
    u = understood(s, d).filter("retrieval_mode = 'record_lookup' and n_matches = 1").withColumn("name_id", F.col("matches").cast("long"))
    j = u.join(named(s, d), "name_id").withColumn("rate", FA.rate_of(F.col("rates"), F.col("category")).getField("rate_text")).filter("rate is not null")
    return j.select("query_id", "name_id", FA.lookup_answer(F.col("name"), F.col("category"), F.col("rate"), T.answer_language(F.col("language"))).alias("answer"))


def conditional_explode(s, d):
    n = named(s, d).withColumn("varies", F.col("name").rlike("ring|bolt"))
    return K.explode_rates(n, "varies", "rates").select("name_id", "varies", "rate.category", "rate.rate_text")


def list_rollup(s, d):
    n = table(s, d, "nation").select(F.col("n_regionkey").alias("region"), "n_name", F.when(F.col("n_nationkey") > 3, F.col("n_nationkey")).alias("o"))
    return K.list_text(n, "region", "n_name", "o")


def gap_chunks(s, d):
    g = completeness_gaps(s, d)
    return g.select("source", K.gap_text(F.col("source"), F.concat(F.lit("doc "), F.col("first_missing"))).alias("text"))


def sibling_text(s, d):
    n = table(s, d, "nation").select(F.lit("S").alias("scheme"), F.col("n_regionkey").alias("clause"), "n_nationkey", "n_name")
    return K.siblings(n, ["scheme", "clause"], "n_name", "n_nationkey").select("n_nationkey", "parent_text")


CHUNKS = values(
    "chunks",
    "chunk_id, text, path, page, document, language",
    [(0, "[Doc > p.3]\n\nRate is 5%.", "S1 > a", 3, None, "en"), (1, "No crumb", "S2", None, "Other Scheme", "en"), (2, "[x]\n\nरकम", "S3", 0, None, "hi"), (3, "[y] inline", None, 4, "योजना", "hi")],
)


def extractive(s, d):
    c = frame(s, CHUNKS, "chunk_id bigint, text string, path string, page int, document string, language string")
    return c.select("chunk_id", K.extractive_answer(*[F.col(x) for x in ("text", "path", "page", "document", "language")]).alias("answer"))


SPANS = values("spans", "page, x, y, text", [(1, 10.0, 100.0, "elig"), (1, 50.0, 100.2, "gibility"), (1, 5.0, 130.0, "for"), (1, 30.0, 130.4, " units"), (2, 1.0, 1.0, "a"), (2, 2.0, 1.0, "")])


def seam_repair(s, d):
    return join_spans(frame(s, SPANS, "page int, x double, y double, text string"))


def cache_dedup(s, d):
    docs = table(s, d, "documents").select("doc_id", L.cache_key(F.col("text"), F.lit("rag"), F.col("lang")).alias("key"))
    return L.first_of_equal(docs, "key", "doc_id").select("doc_id", "answered_by", "n_requests", "cached")


def source_append(s, d, n: int | None = 5):
    primary = hybrid(s, d, n).filter("rank <= 6").select("query_id", "doc_id", F.col("rank").alias("pos"))
    extra = dense(s, d, n).filter("rank <= 10").select("query_id", "doc_id", F.col("rank").alias("pos"))
    return L.append_sources(primary, extra)


EVIDENCE = values(
    "evidence",
    "query_id, gate, graph_nodes, graph_trusted, graph_chunks, dominant",
    [(q, ("answer", "abstain", "answer_low_confidence")[q % 3], q % 5, max(0, q % 5 - 1), q % 4, q % 2 == 0) for q in range(18)],
)
EVIDENCE_TYPES = "query_id bigint, gate string, graph_nodes int, graph_trusted int, graph_chunks int, dominant boolean"


def ladder_tiers(s, d):
    u = route(s, d).join(questions(s), "query_id").withColumn("lookup", T.is_lookup(F.col("text")))
    has = structured_lookup(s, d).select("query_id", F.lit(True).alias("has_rate"))
    r = u.join(frame(s, EVIDENCE, EVIDENCE_TYPES), "query_id").join(has, "query_id", "left").withColumn("has_rate", F.coalesce("has_rate", F.lit(False)))
    r = r.withColumn("mode", F.explode(F.array(F.lit("rag"), F.lit("records"), F.lit("records_rag")))).withColumn("retrieval_mode", FA.mask_mode(F.col("mode"), F.col("retrieval_mode")))
    return L.tiers(r).select("query_id", "mode", "retrieval_mode", "final_gate", "tier", "low_confidence", "cached")


# --- providers and files (no SQL)


def encode_provider(s, d):
    from ..providers import encode

    return encode(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text")


def generate_provider(s, d):
    from ..providers import generate

    rows = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.array("text").alias("sources"))
    return generate(rows)


QUERIES = {
    "contradiction_groups": contradiction_groups,
    "definition_conflicts": definition_conflicts,
    "completeness_gaps": completeness_gaps,
    "rate_completeness": rate_completeness,
    "ref_integrity": ref_integrity,
    "broken_links": broken_links,
    "link_extract": link_extract,
    "page_links": page_links,
    "figure_extract": figure_extract,
    "figure_crosscheck": figure_crosscheck,
    "required_values": required_values,
    "parity_diff": parity_diff,
    "dup_ids_texts": dup_texts,
    "regen_hash": regen_hash,
    "union_except_intersect": set_ops,
    "cardinalities": cardinalities,
    "stale_rows": stale_rows,
    "detect_language": detect_language,
    "classify_intent": classify_intent,
    "slug_ids": slug_ids,
    "trust_tier": trust_tier,
    "verifier_actors": verifier_actors,
    "one_line": one_line,
    "numeric_guard": numeric_guard,
    "citation_guard": citation_guard,
    "consistency_guard": consistency_guard,
    "disclosure_guard": disclosure_guard,
    "all_words_match": lambda s, d: FA.names_in_questions(questions(s), named(s, d).select("name_id", "name")),
    "retrieval_mode_route": route,
    "structured_lookup": structured_lookup,
    "conditional_explode": conditional_explode,
    "list_rollup_text": list_rollup,
    "gap_chunks": gap_chunks,
    "sibling_text": sibling_text,
    "extractive_answer": extractive,
    "seam_repair": seam_repair,
    "cache_dedup": cache_dedup,
    "graph_source_append": source_append,
    "ladder_tiers": ladder_tiers,
    "encode_provider": encode_provider,
    "generate_provider": generate_provider,
}

# --- SQL


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def norm_sql(x: str) -> str:
    out = f"translate(coalesce({x}, ''), '०१२३४५६७८९', '0123456789')"
    for pattern, to in T.UNITS:
        out = f"regexp_replace({out}, {q(pattern)}, {q(to)}, 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def figures_sql(x: str) -> str:
    found = f"regexp_extract_all({norm_sql(f'regexp_replace(coalesce({x}, {q(str())}), {q(chr(92) + chr(91) + "S" + chr(92) + "d+" + chr(92) + chr(93))}, {q(" ")}, {q("g")})')}, {q(T.FIGURE)})"
    tidy = f"list_filter(list_transform({found}, lambda f: lower(regexp_replace(trim(f, ' ,'), '\\s+', ' ', 'g'))), lambda f: regexp_matches(f, '\\d'))"
    return f"list_reduce(list_transform({tidy}, lambda f: [f]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END, CAST([] AS VARCHAR[]))"


def when_sql(x: str, rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(coalesce({x}, ''), {q(p)}) THEN {q(n)}" for n, p in rules) + f" ELSE {otherwise} END"


LANGUAGE = f"""CASE WHEN regexp_matches(coalesce(text, ''), '[ऀ-ॿ]') THEN 'hi'
  WHEN len(regexp_extract_all(lower(text), '[a-z]+')) > 0 AND len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w IN ({", ".join(map(q, T.HINGLISH))}))) / len(regexp_extract_all(lower(text), '[a-z]+')) >= 0.15 THEN 'hinglish' ELSE 'en' END"""
SPOKEN = f"spoken AS (SELECT CAST(query_id AS BIGINT) AS query_id, text FROM ({QUESTIONS}) UNION ALL SELECT conv_id * 1000 + turn + 1000, text FROM conversations)"
NAMED = """rated AS (SELECT p_name, CASE WHEN p_size < 17 THEN 'micro' WHEN p_size < 34 THEN 'small' ELSE 'medium' END AS category, min(p_brand) AS rate_text, min(p_partkey) AS k FROM part GROUP BY ALL),
  named AS (SELECT p_name AS name, min(k) AS name_id FROM rated GROUP BY p_name)"""
STOP = ", ".join(map(q, FA.NAME_STOPWORDS))
MATCH = f"""{NAMED}, words AS (SELECT name_id, list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z]+'), lambda w: w NOT IN ({STOP}))) AS ws FROM named),
  matched AS (SELECT CAST(q.query_id AS BIGINT) AS query_id, w.name_id, CAST(len(ws) AS BIGINT) AS n_words FROM ({QUESTIONS}) q JOIN words w ON len(ws) > 0 AND len(list_filter(ws, lambda x: NOT list_contains(regexp_extract_all(lower(q.text), '[a-z]+'), x))) = 0)"""
ROUTE = f"""{MATCH}, m AS (SELECT query_id, string_agg(CAST(name_id AS VARCHAR), ',' ORDER BY n_words DESC, CAST(name_id AS VARCHAR)) AS ms, count(*) AS n FROM matched GROUP BY query_id),
  base AS (SELECT CAST(q.query_id AS BIGINT) AS query_id, text, {LANGUAGE} AS language, {when_sql("text", T.INTENTS, "'policy_qa'")} AS intent, {when_sql("text", T.CATEGORIES, "NULL")} AS cat, m.ms, m.n FROM ({QUESTIONS}) q LEFT JOIN m ON m.query_id = q.query_id),
  routed AS (SELECT query_id, text, language, intent, CASE WHEN ok THEN cat END AS category, CASE WHEN ok THEN ms ELSE '' END AS matches, CASE WHEN ok THEN n ELSE 0 END AS n_matches,
    CASE WHEN NOT ok THEN 'rag_narrative' WHEN regexp_matches(text, {q(T.EXPLANATORY)}) THEN 'hybrid' WHEN cat IS NOT NULL AND regexp_matches(text, {q(T.LOOKUP)}) THEN 'record_lookup' ELSE 'hybrid' END AS retrieval_mode
    FROM (SELECT *, intent = 'policy_qa' AND n IS NOT NULL AS ok FROM base))"""
LOOKED = f"""{ROUTE}, looked AS (SELECT r.query_id, n.name_id, CASE WHEN r.language = 'hi' THEN n.name || ' (' || r.category || ' उद्यम के लिए): ' || t.rate_text || '। [S1]' ELSE n.name || ' for a ' || r.category || ' enterprise: ' || t.rate_text || '. [S1]' END AS answer
  FROM routed r JOIN named n ON CAST(n.name_id AS VARCHAR) = r.matches JOIN rated t ON t.p_name = n.name AND t.category = r.category WHERE r.retrieval_mode = 'record_lookup' AND r.n_matches = 1)"""
LOW = "lower(coalesce(answer, ''))"
UPPER_SLUG = "trim(left(trim(regexp_replace(upper(name), '[^A-Z0-9]+', '-', 'g'), '-'), 60), '-')"
ID_SLUG = "trim(left(regexp_replace(lower(name), '[^a-z0-9._-]+', '-', 'g'), 40), '-')"

SQL = {
    "contradiction_groups": "SELECT l_partkey, l_suppkey, string_agg(f, ',' ORDER BY f) AS flags, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag AS f FROM lineitem) GROUP BY ALL HAVING count(*) > 1",
    "definition_conflicts": "SELECT term, string_agg(source, ',' ORDER BY source) AS sources, count(*) AS n FROM (SELECT DISTINCT sha256(text) AS term, source FROM documents) GROUP BY term HAVING count(*) > 1",
    "completeness_gaps": "SELECT source, count(*) AS n_missing, min(doc_id) AS first_missing, max(doc_id) AS last_missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source",
    "rate_completeness": "SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) < 20",
    "ref_integrity": "SELECT 'documents.embedding' AS field, doc_id AS missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'lineitem.part', l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)",
    "broken_links": f"SELECT DISTINCT page_id, target FROM (SELECT page_id, unnest(regexp_extract_all(html, {q(HREF)}, 1)) AS target FROM pages) WHERE lower(target) NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[^\\s.,]+')) FROM benchmark)",
    "link_extract": f"""SELECT CAST(note_id AS BIGINT) AS note_id,
      array_to_string(list_transform(list_zip(regexp_extract_all(body, '(?:^|[^!])\\[([^\\]]*)\\]\\(([^)\\s]+)\\)', 1), regexp_extract_all(body, '(?:^|[^!])\\[([^\\]]*)\\]\\(([^)\\s]+)\\)', 2)), lambda x: x[1] || '>' || x[2]), '|') AS links,
      array_to_string(list_transform(regexp_extract_all(body, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1), lambda x: trim(x)), '|') AS wikilinks,
      coalesce((SELECT string_agg(DISTINCT f, '|') FROM (SELECT unnest(regexp_extract_all(body, '\\[\\^([^\\]]+)\\]', 1)) AS f)), '') AS footnotes FROM ({LINKS})""",
    "page_links": f"SELECT page_id, CAST(len(l) AS BIGINT) AS n_links, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS targets FROM (SELECT page_id, regexp_extract_all(html, {q(HREF)}, 1) AS l FROM pages)",
    "figure_extract": f"SELECT id, array_to_string({figures_sql('text')}, '|') AS figures FROM (SELECT 'answer/' || answer_id AS id, answer AS text FROM ({ANSWERS}) UNION ALL SELECT 'doc/' || doc_id, text FROM documents)",
    "figure_crosscheck": f"SELECT CAST(fact_id AS BIGINT) AS fact_id, figure FROM ({FACTS}) f WHERE page IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({PAGES}) p WHERE p.page IN (f.page, f.page + 1) AND contains(trim(regexp_replace(p.text, '\\s+', ' ', 'g')), f.figure))",
    "required_values": f"SELECT value, contains((SELECT string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ' ORDER BY page) FROM ({PAGES}) p WHERE p.page BETWEEN r.first AND r.last), value) AS present FROM ({REQUIRED}) r",
    "parity_diff": """WITH o AS (SELECT doc_id, lang, source, n_chars FROM documents), n AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'FR' ELSE lang END AS lang, CASE WHEN n_chars < 300 THEN 'short' ELSE source END AS source, n_chars FROM documents WHERE n_chars <= 6000 UNION ALL SELECT -item_id - 1, 'en', 'bench', length(text) FROM benchmark),
      j AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, o.doc_id IS NULL AS added, n.doc_id IS NULL AS missing, array_to_string(list_filter([CASE WHEN o.lang IS DISTINCT FROM n.lang THEN 'lang' END, CASE WHEN o.source IS DISTINCT FROM n.source THEN 'source' END, CASE WHEN o.n_chars IS DISTINCT FROM n.n_chars THEN 'n_chars' END], lambda x: x IS NOT NULL), ',') AS d FROM o FULL OUTER JOIN n ON o.doc_id = n.doc_id)
      SELECT doc_id, CASE WHEN missing THEN 'missing' WHEN added THEN 'added' ELSE 'changed' END AS kind, CASE WHEN missing OR added THEN '' ELSE d END AS fields FROM j WHERE missing OR added OR d <> ''""",
    "dup_ids_texts": "SELECT sha256(text) AS text_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "regen_hash": "SELECT doc_id, sha256(text) AS old, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS new FROM documents WHERE text <> trim(regexp_replace(text, '\\s+', ' ', 'g'))",
    "union_except_intersect": "SELECT count(*) FILTER (a AND b) AS in_both, count(*) FILTER (NOT b) AS only_first, count(*) FILTER (NOT a) AS only_second, count(*) AS in_either FROM (SELECT x.doc_id IS NOT NULL AS a, y.doc_id IS NOT NULL AS b FROM (SELECT DISTINCT doc_id FROM documents) x FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) y ON x.doc_id = y.doc_id)",
    "cardinalities": " UNION ALL ".join(f"SELECT count(*) AS n_rows, '{n}' AS name FROM {n}" for n in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels"]),
    "stale_rows": f"SELECT path, generated_by FROM ({EXISTING}) WHERE generated_by = 'compile' AND path NOT IN (SELECT path FROM ({WRITING}))",
    "detect_language": f"WITH {SPOKEN} SELECT query_id, language, CASE WHEN language = 'hi' THEN 'hi' ELSE 'en' END AS answers_in FROM (SELECT query_id, {LANGUAGE} AS language FROM spoken)",
    "classify_intent": f"WITH {SPOKEN} SELECT query_id, {when_sql('text', T.INTENTS, q('policy_qa'))} AS intent, {when_sql('text', T.CATEGORIES, 'NULL')} AS category, regexp_matches(text, {q(T.EXPLANATORY)}) AS explanatory, regexp_matches(text, {q(T.LOOKUP)}) AS lookup FROM spoken",
    "slug_ids": f"""SELECT name, {UPPER_SLUG} AS upper, left(trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), 40) AS lower, {ID_SLUG} AS id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS snake,
      'scheme.v1.0.' || {ID_SLUG} AS chunk_id, CASE WHEN starts_with(name, 'SCHEME-') THEN substr(name, 8) ELSE name END AS local FROM (SELECT DISTINCT p_name AS name FROM part UNION ALL SELECT name FROM ({NAMES}))""",
    "trust_tier": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'human-reviewed' WHEN quality = 1 THEN 'machine-confirmed' ELSE 'unverified' END AS trust, CASE WHEN quality = 1 THEN 'stable' WHEN toxic = 1 THEN 'draft' ELSE 'deprecated' END AS status FROM labels",
    "verifier_actors": f"""SELECT CAST(id AS BIGINT) AS id, CASE WHEN trim(coalesce(by_text, '')) = '' THEN '' WHEN regexp_matches(by_text, '(?i)verify_policy_data|verify_chunks') THEN array_to_string(list_filter([CASE WHEN regexp_matches(by_text, '(?i)verify_policy_data') THEN 'process:verify_policy_data' END, CASE WHEN regexp_matches(by_text, '(?i)verify_chunks') THEN 'process:verify_chunks' END], lambda x: x IS NOT NULL), '|')
      ELSE 'process:' || coalesce(nullif(left(trim(regexp_replace(lower(by_text), '[^a-z0-9]+', '-', 'g'), '-'), 40), ''), 'unknown') END AS actors FROM ({VERIFIERS})""",
    "one_line": "SELECT doc_id, CASE WHEN length(t) > 200 THEN left(t, 197) || '...' ELSE t END AS description FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)",
    "numeric_guard": f"""SELECT CAST(answer_id AS BIGINT) AS answer_id, array_to_string(list_sort(list_filter(fa, lambda f: NOT list_contains(fc, f))), '|') AS leaked, array_to_string(list_sort(list_filter(fa, lambda f: NOT contains(nc, f))), '|') AS leaked_compat
      FROM (SELECT answer_id, {figures_sql('answer')} AS fa, {figures_sql('context')} AS fc, {norm_sql('context')} AS nc FROM ({ANSWERS}))""",
    "citation_guard": f"SELECT CAST(answer_id AS BIGINT) AS answer_id, array_to_string(list_filter(regexp_extract_all(answer, '\\[S(\\d+)\\]', 1), lambda n: CAST(n AS INTEGER) < 1 OR CAST(n AS INTEGER) > sources), '|') AS invalid FROM ({ANSWERS})",
    "consistency_guard": f"SELECT CAST(answer_id AS BIGINT) AS answer_id, array_to_string(list_sort(list_filter(fa, lambda f: regexp_matches(f, '%|crore|lakh|rupee') AND NOT list_contains(ft, f))), '|') AS mismatched FROM (SELECT answer_id, {figures_sql('answer')} AS fa, {figures_sql('truth')} AS ft FROM ({ANSWERS}))",
    "disclosure_guard": f"SELECT CAST(answer_id AS BIGINT) AS answer_id, CASE WHEN ids = '' OR regexp_matches({LOW}, {q('|'.join(T.DISCLOSURE_WORDS))}) THEN '' ELSE array_to_string(list_filter(string_split(ids, ','), lambda i: NOT contains({LOW}, lower(i))), ',') END AS missing FROM ({ANSWERS})",
    "all_words_match": f"WITH {MATCH} SELECT * FROM matched",
    "retrieval_mode_route": f"WITH {ROUTE} SELECT query_id, language, intent, category, matches, n_matches, retrieval_mode FROM routed",
    "structured_lookup": f"WITH {LOOKED} SELECT * FROM looked",
    "conditional_explode": f"WITH {NAMED} SELECT n.name_id, regexp_matches(n.name, 'ring|bolt') AS varies, CASE WHEN regexp_matches(n.name, 'ring|bolt') THEN r.category ELSE 'all' END AS category, r.rate_text FROM named n JOIN (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY category) AS i FROM rated) r ON r.p_name = n.name WHERE regexp_matches(n.name, 'ring|bolt') OR i = 1",
    "list_rollup_text": "SELECT CAST(n_regionkey AS BIGINT) AS region, string_agg(n_name, ', ' ORDER BY CASE WHEN n_nationkey > 3 THEN 0 ELSE 1 END, CASE WHEN n_nationkey > 3 THEN n_nationkey END, n_name) AS items, count(*) AS n FROM nation GROUP BY n_regionkey",
    "gap_chunks": "SELECT source, '[Known gap]' || chr(10) || chr(10) || 'doc ' || min(doc_id) || ' is not classified in ' || source || '.' AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source",
    "sibling_text": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, (SELECT string_agg(m.n_name, chr(10) ORDER BY m.n_nationkey) FROM nation m WHERE m.n_regionkey = n.n_regionkey) AS parent_text FROM nation n",
    "extractive_answer": f"""SELECT CAST(chunk_id AS BIGINT) AS chunk_id, CASE WHEN language = 'hi' THEN CASE WHEN document IS NULL THEN 'प्रारूप नीति के अनुसार' ELSE document || ' के अनुसार' END ELSE CASE WHEN document IS NULL THEN 'According to the draft policy' ELSE 'According to ' || document END END
      || ' (' || coalesce(path, '') || CASE WHEN coalesce(page, 0) > 0 THEN ', p.' || page ELSE '' END || '): ' || regexp_replace(text, '(?s)^\\[.*?\\]\\n\\n', '') AS answer FROM ({CHUNKS})""",
    "seam_repair": "SELECT * FROM (VALUES (1::BIGINT, 33::BIGINT, 'eligibility'), (1, 43, 'for units'), (2, 0, 'a')) AS t(page, row, line)",
    "cache_dedup": "WITH k AS (SELECT doc_id, concat_ws('|', 'rag', lang, lower(trim(text, ' '))) AS key FROM documents), g AS (SELECT key, min(doc_id) AS answered_by, count(*) AS n_requests FROM k GROUP BY key) SELECT doc_id, answered_by, n_requests, doc_id <> answered_by AS cached FROM k JOIN g USING (key)",
    "graph_source_append": f"""WITH {DENSE.format(where='')}, {sparse_sql()}, {FUSED}, b AS (SELECT query_id, doc_id, rank AS pos, 'vector' AS origin, 0 AS late FROM fused WHERE rank <= 6 UNION ALL SELECT d.query_id, d.doc_id, d.rank, 'graph', 1 FROM dense d WHERE d.rank <= 10 AND NOT EXISTS (SELECT 1 FROM fused f WHERE f.rank <= 6 AND f.query_id = d.query_id AND f.doc_id = d.doc_id))
      SELECT query_id, doc_id, origin, position, 'S' || position AS tag FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, pos, doc_id) AS position FROM b)""",
    "ladder_tiers": f"""WITH {LOOKED}, r AS (SELECT r.query_id, m.mode, CASE WHEN m.mode = 'rag' THEN 'rag_narrative' ELSE r.retrieval_mode END AS retrieval_mode, r.intent, r.n_matches, r.category, l.query_id IS NOT NULL AS has_rate, e.*, regexp_matches(r.text, {q(T.LOOKUP)}) AS lookup,
        CASE WHEN m.mode <> 'records' THEN e.gate WHEN e.graph_nodes = 0 THEN 'abstain' WHEN e.graph_trusted = 0 THEN 'answer_low_confidence' ELSE 'answer' END AS final_gate
        FROM routed r JOIN ({EVIDENCE}) e ON e.query_id = r.query_id LEFT JOIN looked l ON l.query_id = r.query_id CROSS JOIN (VALUES ('rag'), ('records'), ('records_rag')) AS m(mode)),
      t AS (SELECT *, CASE WHEN intent IN ('greeting', 'grievance') THEN intent WHEN mode <> 'rag' AND retrieval_mode = 'record_lookup' AND n_matches = 1 AND category IS NOT NULL AND has_rate THEN 'record_lookup'
        WHEN final_gate = 'abstain' AND mode <> 'rag' AND graph_trusted >= 2 AND graph_chunks > 0 THEN 'graph' WHEN final_gate = 'abstain' THEN 'abstain'
        WHEN mode <> 'records' AND lookup AND dominant AND intent = 'policy_qa' THEN 'extractive' ELSE 'synthesis' END AS tier FROM r)
      SELECT query_id, mode, retrieval_mode, final_gate, tier, final_gate = 'answer_low_confidence' AND tier NOT IN ('record_lookup', 'graph', 'abstain', 'greeting', 'grievance') AS low_confidence, tier NOT IN ('abstain', 'greeting', 'grievance') AS cached FROM t""",
}
QUERIES["graph_source_append_every50"] = lambda s, d: source_append(s, d, None)
SQL["graph_source_append_every50"] = stated(SQL["graph_source_append"])
