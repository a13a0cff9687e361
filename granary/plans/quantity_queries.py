"""Queries over typed quantities, with their SQL. The SQL takes matches, offsets and values by other means than the library's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quantities as Q
from ..operators import compilation as C
from .record_queries import norm_sql, q
from .retrieval_queries import table

TAG = "<[^>]*>"


def under(grammar: str):
    return lambda x: F.struct(F.lit(grammar).alias("grammar"), x.alias("x"))


def typed_quantities(s: SparkSession, d: str) -> DataFrame:
    """Every quantity of every document under each grammar."""
    docs = table(s, d, "documents").select("doc_id", "text")
    named = [F.transform(Q.quantities(F.col("text"), g), under(g)) for g in Q.PATTERNS]
    rows = docs.select("doc_id", F.explode(F.concat(*named)).alias("r"))
    return rows.select("doc_id", "r.grammar", F.col("r.x.surface"), F.col("r.x.start").alias("start_at"), F.col("r.x.end").alias("end_at"), F.col("r.x.value"), F.col("r.x.unit"))


def quantity_crosscheck(s: SparkSession, d: str) -> DataFrame:
    """Quantities of a document that stand neither on the page of its number nor on the next one."""
    facts = table(s, d, "documents").select(F.col("doc_id").alias("fact_id"), "text", F.col("doc_id").alias("page"))
    return C.quantity_crosscheck(facts, table(s, d, "pages").select(F.col("page_id").alias("page"), F.regexp_replace("html", TAG, " ").alias("text")))


def shared_quantities(s: SparkSession, d: str) -> DataFrame:
    """For each value and kind how many documents state it and under how many spellings."""
    docs = table(s, d, "documents").select("doc_id", F.explode(Q.quantities(F.col("text"), "stated")).alias("x"))
    rows = docs.select("doc_id", F.col("x.value").alias("value"), Q.kind(F.col("x.unit")).alias("kind"), F.col("x.surface").alias("surface"))
    once = rows.groupBy("value", "kind", "surface", "doc_id").agg(F.count("*").alias("n"))
    return once.groupBy("value", "kind").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("surface").alias("n_spellings"), F.sum("n").alias("n_quantities"))


QUERIES = {"typed_quantities": typed_quantities, "quantity_crosscheck": quantity_crosscheck, "shared_quantities": shared_quantities}

# --- SQL


def uniform_sql(x: str) -> str:
    r"""norm_sql with word boundaries that know accented letters: DuckDB's \b does not, so a mark joins them to their neighbours for the while."""
    joined = f"regexp_replace(regexp_replace(coalesce({x}, ''), '([À-ɏ])([A-Za-z])', '\\1QZZQ\\2', 'g'), '([A-Za-z])([À-ɏ])', '\\1QZZQ\\2', 'g')"
    return f"replace({norm_sql(joined)}, 'QZZQ', '')"


def spans_sql(rows: str, key: str, grammar: str) -> str:
    """(key, surface, start_at, end_at, value, unit); each match is sought in what is left behind the one before by its number of characters."""
    text = uniform_sql(f"regexp_replace(text, {q(chr(92) + '[S' + chr(92) + 'd+' + chr(92) + ']')}, ' ', 'g')") if grammar == "stated" else "coalesce(text, '')"
    shown = "lower(trim(m, ' ,'))" if grammar == "stated" else "m"
    number = q(Q.NUMBER)
    whole, part = f"replace(regexp_extract(m, {number}, 1), ',', '')", f"regexp_extract(m, {number}, 2)"
    moved = f"CASE WHEN contains(lower(m), 'cro') THEN {Q.CRORE} WHEN contains(lower(m), 'lakh') THEN {Q.LAKH} ELSE 0 END"
    value = f"CASE WHEN NOT regexp_matches(w, '[1-9]') THEN '0' ELSE regexp_replace(CASE WHEN regexp_matches(w[p + 1:], '[1-9]') THEN regexp_replace(w[:p] || '.' || w[p + 1:], '0*$', '') ELSE w[:p] END, '^0+([0-9])', '\\1') END"
    unit = "CASE WHEN contains(lower(m), '%') THEN 'percent' WHEN contains(lower(m), 'kw') THEN 'kw' WHEN regexp_matches(lower(m), 'rupee|rs|₹|/-') THEN 'rupee' ELSE 'number' END"
    none = grammar == "present"
    return f"""SELECT {key}, {shown} AS surface, CAST(from_at AS BIGINT) AS start_at, CAST(from_at + length({shown}) AS BIGINT) AS end_at,
      {"CAST(NULL AS VARCHAR)" if none else value} AS value, {"CAST(NULL AS VARCHAR)" if none else unit} AS unit FROM (
      SELECT *, length({whole}) + {moved} AS p, {whole} || {part} || repeat('0', {moved}) AS w FROM (
        SELECT {key}, m, sum(length(g) + length(m)) OVER (PARTITION BY {key} ORDER BY i) - length(m) AS from_at FROM (
          SELECT {key}, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM (
            SELECT {key}, regexp_extract_all(t, {q(Q.PATTERNS[grammar])}) AS ms, regexp_split_to_array(t, {q(Q.PATTERNS[grammar])}) AS gs FROM (SELECT {key}, {text} AS t FROM {rows})))))"""


def amounts_sql(rows: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, value, CASE unit WHEN 'rupee' THEN 'number' ELSE unit END AS kind FROM ({spans_sql(rows, key, 'stated')})"


STATED = f"SELECT *, CASE unit WHEN 'rupee' THEN 'number' ELSE unit END AS kind FROM ({spans_sql('documents', 'doc_id', 'stated')})"
SQL = {
    "typed_quantities": " UNION ALL ".join(f"SELECT '{g}' AS grammar, * FROM ({spans_sql('documents', 'doc_id', g)})" for g in Q.PATTERNS),
    "quantity_crosscheck": f"""WITH held AS ({amounts_sql(f"(SELECT page_id, regexp_replace(html, {q(TAG)}, ' ', 'g') AS text FROM pages)", "page_id")})
      SELECT doc_id AS fact_id, value, kind FROM ({amounts_sql("documents", "doc_id")}) f
      WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.page_id = f.doc_id AND h.value = f.value AND h.kind = f.kind) AND NOT EXISTS (SELECT 1 FROM held h WHERE h.page_id = f.doc_id + 1 AND h.value = f.value AND h.kind = f.kind)""",
    "shared_quantities": f"SELECT value, kind, count(DISTINCT doc_id) AS n_docs, count(DISTINCT surface) AS n_spellings, CAST(count(*) AS BIGINT) AS n_quantities FROM ({STATED}) GROUP BY value, kind",
}
