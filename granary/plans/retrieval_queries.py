"""Queries over retrieval operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.retrieve import retrieve

TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(s, d) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def asked(key: str, n: int | None, shift: int = 0):
    """The query set: ids below n, or (None) the stated one, every id divisible by 50; ids are moved by ``shift``."""
    at = F.col(key) - shift
    return at % 50 == 0 if n is None else at < n


def dense(s, d, n: int | None = 5, keep=None, among=None) -> DataFrame:
    v = vectors(s, d)
    return R.dense_topk(v if among is None else v.join(among, "doc_id", "left_semi"), v.filter(asked("doc_id", n)).select(F.col("doc_id").alias("query_id"), "embedding"), keep=keep)


def in_english(s, d) -> DataFrame:
    return table(s, d, "documents").filter("lang = 'en'").select("doc_id")


def sparse(s, d, items=None, n: int | None = 5) -> DataFrame:
    q = items if items is not None else table(s, d, "benchmark").filter(asked("item_id", n)).select(F.col("item_id").alias("query_id"), "text")
    return R.sparse_search(table(s, d, "documents").select("doc_id", "text"), q)


def hybrid(s, d, n: int | None = 5) -> DataFrame:
    return R.rrf_fuse(dense(s, d, n), sparse(s, d, n=n))


def reranked(s, d, n: int | None = 5) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    q = table(s, d, "benchmark").filter(asked("item_id", n)).select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    c = sparse(s, d, n=n).filter(F.col("rank") <= R.SHORTLIST).select("query_id", "doc_id")
    return R.rerank(c.join(docs, "doc_id").join(F.broadcast(q), "query_id")).drop("query_text", "text")


THRESHOLDS = [("en", 0.6, 0.985), ("fr", 0.9, 0.99), ("default", 0.5, 0.7)]


def thresholds(s) -> DataFrame:
    return s.createDataFrame(THRESHOLDS, "source_type string, tau_hard double, tau_soft double")


def gate(s, d, n: int | None = 5) -> DataFrame:
    # a query without candidates (item -1) must abstain
    qs = table(s, d, "benchmark").filter(asked("item_id", n)).select(F.col("item_id").alias("query_id")).union(s.range(1).select(F.lit(-1).cast("long")))
    return R.coverage_gate(qs, reranked(s, d, n), thresholds(s), "lang")


def variants(s, d, n: int | None = 5) -> DataFrame:
    b = table(s, d, "benchmark")
    lists = []
    for v in (0, 1):
        q = b.filter((F.col("item_id") >= v) & asked("item_id", n, v)).select((F.col("item_id") - v).alias("query_id"), "text")
        lists.append(sparse(s, d, q).withColumn("variant", F.lit(v)))
    return R.merge_variants(lists[0].unionByName(lists[1]))


DENSE = """dense AS (SELECT query_id, doc_id, score, rank FROM (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) /
      sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score
    FROM embeddings v, embeddings q WHERE q.vec_id < 5{where})) WHERE rank <= 30)"""


def sparse_sql(name: str = "sparse", n: int = 5, shift: int = 0) -> str:
    return f"""{name} AS (SELECT query_id, doc_id, score, rank FROM (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT q.query_id, p.doc_id, CAST(sum(p.tf * q.tf) AS DOUBLE) AS score
    FROM (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS t FROM documents) GROUP BY ALL) p
    JOIN (SELECT query_id, t, count(*) AS tf FROM (SELECT item_id - {shift} AS query_id, unnest({TOKENS}) AS t FROM benchmark WHERE item_id >= {shift} AND item_id < {n + shift}) GROUP BY ALL) q USING (t)
    GROUP BY ALL)) WHERE rank <= 30)"""


FUSED = """fused AS (SELECT query_id, doc_id, dense_rank, sparse_rank, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT query_id, doc_id, d.rank AS dense_rank, s.rank AS sparse_rank,
      round(coalesce(1e0 / (60 + d.rank), 0e0) + coalesce(1e0 / (60 + s.rank), 0e0), 9) AS score
    FROM dense d FULL OUTER JOIN sparse s USING (query_id, doc_id))) WHERE rank <= 12)"""


def rerank_sql(n: int = 5) -> str:
    return f"""{sparse_sql(n=n)},
reranked AS (SELECT query_id, doc_id, lang, source, n_chars, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT c.query_id, c.doc_id, d.lang, d.source, d.n_chars,
      round(1 / (1 + exp(-(8e0 * len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')), regexp_extract_all(lower(d.text), '[a-z0-9]+')))
        / greatest(len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+'))), 1) - 4))), 6) AS score
    FROM sparse c JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = c.query_id WHERE c.rank <= 12)) WHERE rank <= 12)"""


GATE = """thresholds AS (SELECT * FROM (VALUES ('en', 0.6e0, 0.985e0), ('fr', 0.9e0, 0.99e0)) AS t(lang, h, s)),
gate AS (SELECT q.query_id, coalesce(r.score, 0e0) AS top_score, coalesce(t.h, 0.5e0) AS tau_hard, coalesce(t.s, 0.7e0) AS tau_soft,
  CASE WHEN coalesce(r.score, 0e0) < coalesce(t.h, 0.5e0) THEN 'abstain' WHEN coalesce(r.score, 0e0) < coalesce(t.s, 0.7e0) THEN 'answer_low_confidence' ELSE 'answer' END AS action
  FROM (SELECT item_id AS query_id FROM benchmark WHERE item_id < 5 UNION ALL SELECT -1) q
  LEFT JOIN (SELECT * FROM reranked WHERE rank = 1) r USING (query_id) LEFT JOIN thresholds t USING (lang))"""


def point_lookup(s, d) -> DataFrame:
    ids = s.createDataFrame([(i,) for i in (0, 3, 7, 11, 42, 99, 123456789, -1)], "doc_id long")
    return table(s, d, "documents").join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "lang", "source", "n_chars")


def seeds(s, d, n: int | None = 5) -> DataFrame:
    lab = vectors(s, d).select("doc_id", "label")
    rows = hybrid(s, d, n).filter("rank <= 6").join(lab, "doc_id")
    return R.ordered_distinct(rows, ["query_id"], "label", "rank", 6, "seeds")


QUERIES = {
    "dense_knn_top30": dense,
    "filtered_knn": lambda s, d: dense(s, d, keep=F.col("label") % 2 == 0),
    "sparse_dot_top30": sparse,
    "hybrid_rrf_top12": hybrid,
    "variant_merge_rrf": variants,
    "point_lookup_ids": point_lookup,
    "rerank_sigmoid": reranked,
    "coverage_gate": gate,
    "dominant_lookup": lambda s, d: R.dominant(reranked(s, d), gate(s, d)),
    "doc_order_context": lambda s, d: R.document_order(reranked(s, d), "n_chars", "source").select("query_id", "doc_id", "score", "rank", "position", "tag"),
    "section_suggestions": lambda s, d: R.suggestions(reranked(s, d), "source"),
    "seed_entities_top6": seeds,
}

SQL = {
    "dense_knn_top30": f"WITH {DENSE.format(where='')} SELECT * FROM dense",
    "filtered_knn": f"WITH {DENSE.format(where=' AND v.label % 2 = 0')} SELECT * FROM dense",
    "sparse_dot_top30": f"WITH {sparse_sql()} SELECT * FROM sparse",
    "hybrid_rrf_top12": f"WITH {DENSE.format(where='')}, {sparse_sql()}, {FUSED} SELECT * FROM fused",
    "variant_merge_rrf": f"""WITH {sparse_sql('a')}, {sparse_sql('b', shift=1)} SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT query_id, doc_id, round(sum(1e0 / (60 + rank)), 9) AS score, min(rank) AS best_rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)) WHERE rank <= 12""",
    "point_lookup_ids": "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (0, 3, 7, 11, 42, 99, 123456789, -1)",
    "rerank_sigmoid": f"WITH {rerank_sql()} SELECT doc_id, query_id, lang, source, n_chars, score, rank FROM reranked",
    "coverage_gate": f"WITH {rerank_sql()}, {GATE} SELECT * FROM gate",
    "dominant_lookup": f"""WITH {rerank_sql()}, {GATE}, led AS (SELECT query_id, rank, score, lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS next FROM reranked)
      SELECT g.query_id, g.action = 'answer' AND l.score IS NOT NULL AND (l.next IS NULL OR round(l.score - l.next, 6) > 0.15) AS dominant FROM gate g LEFT JOIN led l ON l.query_id = g.query_id AND l.rank = 1""",
    "doc_order_context": f"""WITH {rerank_sql()} SELECT *, 'S' || position AS tag FROM (SELECT query_id, doc_id, score, rank,
      row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank = 1 THEN 0 ELSE 1 END, coalesce(n_chars, 0), coalesce(source, ''), doc_id) AS position FROM reranked WHERE rank <= 6)""",
    "section_suggestions": f"""WITH {rerank_sql()} SELECT * FROM (SELECT query_id, source, first, row_number() OVER (PARTITION BY query_id ORDER BY first, source) AS position
      FROM (SELECT query_id, source, min(rank) AS first FROM reranked GROUP BY ALL)) WHERE position <= 3""",
    "seed_entities_top6": f"""WITH {DENSE.format(where='')}, {sparse_sql()}, {FUSED}, f AS (SELECT query_id, label, min(rank) AS o FROM fused JOIN embeddings ON vec_id = doc_id WHERE rank <= 6 GROUP BY ALL)
      SELECT query_id, string_agg(CAST(label AS VARCHAR), ',' ORDER BY o, CAST(label AS VARCHAR)) AS seeds FROM f GROUP BY query_id""",
}

# --- the same over the stated query set: every id divisible by 50, against all rows


def stated(sql: str) -> str:
    """SQL of a query over five ids -> that over every id divisible by 50."""
    for five, every in (
        ("q.vec_id < 5", "q.vec_id % 50 = 0"),
        ("item_id >= 0 AND item_id < 5", "item_id >= 0 AND item_id % 50 = 0"),
        ("item_id >= 1 AND item_id < 6", "item_id >= 1 AND (item_id - 1) % 50 = 0"),
        ("item_id < 5 UNION", "item_id % 50 = 0 UNION"),
    ):
        sql = sql.replace(five, every)
    return sql


def ordered(s, d, n: int | None) -> DataFrame:
    return R.document_order(reranked(s, d, n), "n_chars", "source").select("query_id", "doc_id", "score", "rank", "position", "tag")


EVERY = {
    "dense_knn_top30": lambda s, d: dense(s, d, None),
    "filtered_knn": lambda s, d: dense(s, d, None, among=in_english(s, d)),
    "sparse_dot_top30": lambda s, d: sparse(s, d, n=None),
    "hybrid_rrf_top12": lambda s, d: hybrid(s, d, None),
    "variant_merge_rrf": lambda s, d: variants(s, d, None),
    "rerank_sigmoid": lambda s, d: reranked(s, d, None),
    "coverage_gate": lambda s, d: gate(s, d, None),
    "dominant_lookup": lambda s, d: R.dominant(reranked(s, d, None), gate(s, d, None)),
    "doc_order_context": lambda s, d: ordered(s, d, None),
    "section_suggestions": lambda s, d: R.suggestions(reranked(s, d, None), "source"),
    "seed_entities_top6": lambda s, d: seeds(s, d, None),
}
QUERIES |= {f"{k}_every50": f for k, f in EVERY.items()}
SQL |= {f"{k}_every50": stated(SQL[k]) for k in EVERY}
IN_ENGLISH = " AND v.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"
SQL["filtered_knn_every50"] = stated(f"WITH {DENSE.format(where=IN_ENGLISH)} SELECT * FROM dense")

# --- the whole retrieval: items divisible by 50 in two wordings (their own and that of the item after), documents gated by language


def retrieve_top12(s, d) -> DataFrame:
    items = table(s, d, "benchmark").join(vectors(s, d).select(F.col("doc_id").alias("item_id"), "embedding"), "item_id", "left")
    wordings = items.select("text", "embedding", "item_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("variant")).filter((F.col("item_id") >= F.col("variant")) & ((F.col("item_id") - F.col("variant")) % 50 == 0))
    questions = wordings.select((F.col("item_id") - F.col("variant")).alias("query_id"), "variant", "text", "embedding")
    return retrieve(questions, table(s, d, "documents").select("doc_id", "text", "lang"), vectors(s, d), thresholds(s), "lang")


QUERIES["retrieve_top12"] = retrieve_top12
SQL["retrieve_top12"] = f"""WITH qs AS (SELECT item_id - v AS query_id, v, text, embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id, (VALUES (0), (1)) AS w(v) WHERE item_id >= v AND (item_id - v) % 50 = 0),
dense AS (SELECT query_id, v, doc_id, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT q.query_id, q.v, e.vec_id AS doc_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) /
    sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score FROM embeddings e, qs q WHERE q.embedding IS NOT NULL) QUALIFY rank <= 30),
sparse AS (SELECT query_id, v, doc_id, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT q.query_id, q.v, p.doc_id, sum(p.tf * q.tf) AS score FROM (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS t FROM documents) GROUP BY ALL) p
  JOIN (SELECT query_id, v, t, count(*) AS tf FROM (SELECT query_id, v, unnest({TOKENS}) AS t FROM qs) GROUP BY ALL) q USING (t) GROUP BY ALL) QUALIFY rank <= 30),
lists AS (SELECT query_id, v, doc_id, row_number() OVER (PARTITION BY query_id, v ORDER BY round(coalesce(1e0 / (60 + d.rank), 0e0) + coalesce(1e0 / (60 + s.rank), 0e0), 9) DESC, doc_id) AS place
  FROM dense d FULL OUTER JOIN sparse s USING (query_id, v, doc_id) QUALIFY place <= 12),
short AS (SELECT query_id, doc_id, round(sum(1e0 / (60 + place)), 9) AS fused FROM lists GROUP BY ALL),
short12 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS fused_rank FROM short QUALIFY fused_rank <= 12),
own AS (SELECT query_id, text FROM qs WHERE v = 0),
pairs AS (SELECT query_id, doc_id, lang, fused, fused_rank, list_distinct(regexp_extract_all(lower(own.text), '[a-z0-9]+')) AS w, regexp_extract_all(lower(d.text), '[a-z0-9]+') AS t FROM short12 JOIN documents d USING (doc_id) JOIN own USING (query_id)),
scored AS (SELECT query_id, doc_id, lang, fused, fused_rank, round(1 / (1 + exp(-(8e0 * len(list_intersect(w, t)) / greatest(len(w), 1) - 4))), 6) AS score FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored),
thresholds AS (SELECT * FROM (VALUES ('en', 0.6e0, 0.985e0), ('fr', 0.9e0, 0.99e0)) AS t(lang, h, s)),
gate AS (SELECT query_id, coalesce(score, 0e0) AS top_score, CASE WHEN coalesce(score, 0e0) < coalesce(h, 0.5e0) THEN 'abstain' WHEN coalesce(score, 0e0) < coalesce(s, 0.7e0) THEN 'answer_low_confidence' ELSE 'answer' END AS action
  FROM own LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) USING (query_id) LEFT JOIN thresholds USING (lang))
SELECT query_id, action, top_score, doc_id, score, rank, fused, fused_rank FROM gate LEFT JOIN ranked USING (query_id)"""
