"""Structured lookup and routing: names all of whose words stand in a question, and what to do with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alpha_words, classify_intent, detect_category, detect_language, is_explanatory, is_lookup

#: Words that a name need not share with a question.
NAME_STOPWORDS = ("a", "an", "and", "for", "of", "on", "the", "to", "up", "in", "under", "scheme", "incentive", "subsidy")


def name_words(name: Column) -> Column:
    return F.array_distinct(F.filter(alpha_words(name), lambda w: ~w.isin(*NAME_STOPWORDS)))


def names_in_questions(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, name_id, n_words) of names whose significant words all occur; an equi-join on words, then a count."""
    n = names.withColumn("__w", name_words(F.col("name"))).filter(F.size("__w") > 0)
    q = questions.select("query_id", F.explode(F.array_distinct(alpha_words(F.col("text")))).alias("word"))
    hits = n.select("name_id", F.size("__w").alias("n_words"), F.explode("__w").alias("word")).join(q, "word")
    return hits.groupBy("query_id", "name_id", "n_words").agg(F.count("*").alias("c")).filter("c = n_words").drop("c")


def understand(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Language, intent, category, matched names and the retrieval mode of each question."""
    m = names_in_questions(questions, names).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n_words")).alias("o"), F.col("name_id").cast("string").alias("v")))), lambda s: s.v), ",").alias("matches"), F.count("*").alias("n_matches"))
    t = F.col("text")
    out = questions.join(m, "query_id", "left").withColumns({"language": detect_language(t), "intent": classify_intent(t), "category": detect_category(t)})
    eligible = (F.col("intent") == "policy_qa") & F.col("n_matches").isNotNull()
    mode = F.when(~eligible, "rag_narrative").when(is_explanatory(t), "hybrid").when(F.col("category").isNotNull() & is_lookup(t), "record_lookup").otherwise("hybrid")
    out = out.withColumn("retrieval_mode", mode)
    return out.withColumns({"matches": F.when(eligible, F.col("matches")).otherwise(F.lit("")), "n_matches": F.when(eligible, F.col("n_matches")).otherwise(F.lit(0)).cast("long"), "category": F.when(eligible, F.col("category"))})


def mask_mode(mode: Column, retrieval_mode: Column) -> Column:
    """Plain retrieval never uses records."""
    return F.when(mode == "rag", F.lit("rag_narrative")).otherwise(retrieval_mode)


def rate_of(rates: Column, category: Column) -> Column:
    """The first rate of a category, null if there is none."""
    return F.get(F.filter(rates, lambda r: r.category == category), F.lit(0))


def lookup_answer(name: Column, category: Column, rate: Column, language: Column) -> Column:
    en = F.concat(name, F.lit(" for a "), category, F.lit(" enterprise: "), rate, F.lit(". [S1]"))
    hi = F.concat(name, F.lit(" ("), category, F.lit(" उद्यम के लिए): "), rate, F.lit("। [S1]"))
    return F.when(language == "hi", hi).otherwise(en)
