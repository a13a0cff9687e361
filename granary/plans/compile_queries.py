"""Queries over versioned sets of tables, incremental compiles and declared rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import simple_upper
from ..operators import constraints as K
from ..operators import incremental as I
from ..operators.compilation import union_all
from ..sources import snapshot
from .retrieval_queries import table

# --- versioned sets of tables


def snapshot_versions(s, d) -> DataFrame:
    """Three publications of a set, the third refused for its errors, read back: rows and characters by version and table."""
    folder = snapshot.scratch(s)
    docs, labels = table(s, d, "documents"), table(s, d, "labels")
    snapshot.write({"documents": docs}, folder, expected=-1)
    snapshot.write({"labels": labels}, folder, {"no quality": labels.filter("quality not in (0, 1)")}, expected=0)  # documents are taken over
    try:
        snapshot.write({"documents": docs.filter("n_chars < 1000")}, folder, {"short texts": docs.filter("n_chars < 10")}, expected=1)
    except snapshot.Rejected:
        pass
    parts = []
    for v in snapshot.versions(s, folder):
        tables = snapshot.read(s, folder, v)
        told = snapshot.manifest(s, folder, v).tables
        for name in sorted(tables):
            n = F.sum("n_chars") if name == "documents" else F.lit(0)
            parts.append(tables[name].agg(F.lit(v).alias("version"), F.lit(name).alias("name"), F.count("*").alias("n"), F.lit(told[name]["rows"]).cast("long").alias("told"), n.cast("long").alias("chars")))
    return union_all(parts)


# --- incremental compile: notes refer to the note with a third of their number; two versions differ by edits, additions and removals


def note_versions(s, d) -> tuple[DataFrame, DataFrame]:
    notes = table(s, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") > 0, F.floor(F.col("doc_id") / 3)).alias("refers"))
    old = notes.filter("doc_id % 83 <> 7")
    new = notes.filter("doc_id % 89 <> 3").withColumn("text", F.when(F.col("doc_id") % 97 == 5, simple_upper(F.col("text"))).otherwise(F.col("text")))
    return old, new


def links_of(notes: DataFrame) -> DataFrame:
    return notes.filter("refers is not null").select(F.col("doc_id").alias("src"), F.col("refers").alias("dst"))


def breadcrumbs(some: DataFrame, every: DataFrame) -> DataFrame:
    """doc_id, title, path: the titles of the note that a note refers to and of the one that that refers to; a missing one is told."""
    title = F.left(F.regexp_replace("text", r"[ \t\n\f\r]+", " "), F.lit(20))  # SQL's \s has no vertical tab
    one = every.select(F.col("doc_id").alias("r1"), title.alias("t1"), F.col("refers").alias("n2"))
    two = every.select(F.col("doc_id").alias("r2"), title.alias("t2"))
    j = some.join(one, F.col("refers") == F.col("r1"), "left").join(two, F.col("n2") == F.col("r2"), "left")
    path = F.concat(F.coalesce("t2", F.lit("?")), F.lit(" > "), F.coalesce("t1", F.lit("?")))
    return j.select("doc_id", title.alias("title"), path.alias("path"))


def compiled(s, d) -> tuple[DataFrame, DataFrame]:
    old, new = note_versions(s, d)
    before = I.held(breadcrumbs(old, old))
    return I.compile_delta(old, before, new, links_of, breadcrumbs, "doc_id", ["text", "refers"], most_rounds=2)


# --- declared rules


def ruled_tables(s, d) -> list[K.Table]:
    return [
        K.Table("documents", table(s, d, "documents"), "doc_id", [
            K.required("source"), K.one_of("lang", ("en", "fr", "de")), K.length("text", 40, 8000), K.pattern("source", r"^src1?\d$"), K.number("n_chars", 60, 9000),
            K.pattern("text", r"[.!?]\s*$", when="lang = 'en' and n_chars > 2000"), K.Unique(("source", "n_chars")),
        ]),
        K.Table("labels", table(s, d, "labels"), "doc_id", [K.one_of("toxic", (0,), when="quality = 1"), K.one_of("quality", (1,), when="doc_id % 2 = 0"), K.Resolve("doc_id", "documents", "doc_id")]),
        K.Table("pages", table(s, d, "pages"), "page_id", [K.pattern("url", "^https?://[a-z0-9]"), K.length("html", 200), K.Resolve("page_id", "documents", "doc_id"), K.Resolve("page_id", "labels", "doc_id", when="page_id < 100"), K.Unique(("url",))]),
        K.Table("embeddings", table(s, d, "embeddings"), "vec_id", [K.items("embedding", 64, 64), K.number("embedding[]", -0.3, 0.3), K.Resolve("vec_id", "labels", "doc_id")]),
    ]


QUERIES = {
    "snapshot_versions": snapshot_versions,
    "incremental_compile": lambda s, d: compiled(s, d)[0],
    "incremental_report": lambda s, d: compiled(s, d)[1],
    "constraint_violations": lambda s, d: K.violations(ruled_tables(s, d)),
}

NOTES_SQL = """notes AS (SELECT doc_id, text, CASE WHEN doc_id > 0 THEN doc_id // 3 END AS refers FROM documents), old AS (SELECT * FROM notes WHERE doc_id % 83 <> 7),
  new AS (SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN upper(text) ELSE text END AS text, refers FROM notes WHERE doc_id % 89 <> 3)"""
TITLE = "left(regexp_replace({0}.text, '\\s+', ' ', 'g'), 20)"


def rule_sql(name: str, key: str, rule: str, detail: str, where: str) -> str:
    return f"SELECT '{name}' AS \"table\", CAST({key} AS VARCHAR) AS row, '{rule}' AS rule, '{detail}' AS detail FROM {name} WHERE {where}"


def resolve_sql(name: str, key: str, target: str, where: str = "TRUE") -> str:
    return f"SELECT '{name}', CAST({key} AS VARCHAR), 'resolve', '{key}=' || {key} FROM {name} WHERE {where} AND {key} NOT IN (SELECT doc_id FROM {target})"


SQL = {
    "snapshot_versions": """SELECT 0::BIGINT AS version, 'documents' AS name, count(*) AS n, count(*) AS told, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents UNION ALL SELECT 1, 'documents', count(*), count(*), CAST(sum(n_chars) AS BIGINT) FROM documents
      UNION ALL SELECT 1, 'labels', count(*), count(*), 0 FROM labels UNION ALL SELECT 2, 'documents', count(*), count(*), CAST(sum(n_chars) AS BIGINT) FROM documents WHERE n_chars < 1000 HAVING (SELECT count(*) FROM documents WHERE n_chars < 10) = 0
      UNION ALL SELECT 2, 'labels', count(*), count(*), 0 FROM labels HAVING (SELECT count(*) FROM documents WHERE n_chars < 10) = 0""",
    "incremental_compile": f"""WITH {NOTES_SQL} SELECT n.doc_id, {TITLE.format('n')} AS title, coalesce({TITLE.format('b')}, '?') || ' > ' || coalesce({TITLE.format('a')}, '?') AS path FROM new n LEFT JOIN new a ON a.doc_id = n.refers LEFT JOIN new b ON b.doc_id = a.refers""",
    "incremental_report": f"""WITH {NOTES_SQL}, ch AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old o FULL OUTER JOIN new n ON o.doc_id = n.doc_id WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.text IS DISTINCT FROM n.text),
      links AS (SELECT doc_id AS src, refers AS dst FROM notes WHERE refers IS NOT NULL AND refers <> doc_id), r1 AS (SELECT DISTINCT src AS doc_id FROM links WHERE dst IN (SELECT doc_id FROM ch) AND src NOT IN (SELECT doc_id FROM ch)),
      r2 AS (SELECT DISTINCT src AS doc_id FROM links WHERE dst IN (SELECT doc_id FROM r1) AND src NOT IN (SELECT doc_id FROM ch) AND src NOT IN (SELECT doc_id FROM r1))
      SELECT doc_id, change, 0::BIGINT AS ring FROM ch UNION ALL SELECT doc_id, 'dependent', 1 FROM r1 UNION ALL SELECT doc_id, 'dependent', 2 FROM r2""",
    "constraint_violations": " UNION ALL ".join([
        rule_sql("documents", "doc_id", "required", "source", "source IS NULL OR trim(source) = ''"),
        rule_sql("documents", "doc_id", "enum", "lang", "lang NOT IN ('en', 'fr', 'de')"),
        rule_sql("documents", "doc_id", "length", "text", "length(text) < 40 OR length(text) > 8000"),
        rule_sql("documents", "doc_id", "pattern", "source", "NOT regexp_matches(source, '^src1?\\d$')"),
        rule_sql("documents", "doc_id", "number", "n_chars", "n_chars < 60 OR n_chars > 9000"),
        rule_sql("documents", "doc_id", "pattern", "text", "lang = 'en' AND n_chars > 2000 AND NOT regexp_matches(text, '[.!?]\\s*$')"),
        "SELECT 'documents', CAST(doc_id AS VARCHAR), 'unique', 'source,n_chars' FROM (SELECT *, count(*) OVER (PARTITION BY source, n_chars) AS n FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL) WHERE n > 1",
        rule_sql("labels", "doc_id", "enum", "toxic", "quality = 1 AND toxic <> 0"),
        rule_sql("labels", "doc_id", "enum", "quality", "doc_id % 2 = 0 AND quality <> 1"),
        resolve_sql("labels", "doc_id", "documents"),
        rule_sql("pages", "page_id", "pattern", "url", "NOT regexp_matches(url, '^https?://[a-z0-9]')"),
        rule_sql("pages", "page_id", "length", "html", "length(html) < 200"),
        resolve_sql("pages", "page_id", "documents"),
        resolve_sql("pages", "page_id", "labels", "page_id < 100"),
        "SELECT 'pages', CAST(page_id AS VARCHAR), 'unique', 'url' FROM (SELECT *, count(*) OVER (PARTITION BY url) AS n FROM pages WHERE url IS NOT NULL) WHERE n > 1",
        rule_sql("embeddings", "vec_id", "items", "embedding", "len(embedding) <> 64"),
        rule_sql("embeddings", "vec_id", "number", "embedding[]", "len(list_filter(embedding, lambda x: x::DOUBLE < -0.3 OR x::DOUBLE > 0.3)) > 0"),
        resolve_sql("embeddings", "vec_id", "labels"),
    ]),
}
