"""Rendering records into retrievable chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rates(records: DataFrame, varies: str, rates: str) -> DataFrame:
    """One chunk per category if the record says that its rates vary, else one for all categories.

    The flag is authored, never derived from the rates. Without variation the first rate speaks.
    """
    every = F.transform(F.col(rates), lambda r: F.struct(r.category.alias("category"), r.rate_text.alias("rate_text")))
    one = F.array(F.struct(F.lit("all").alias("category"), F.get(F.col(rates), F.lit(0)).getField("rate_text").alias("rate_text")))
    return records.withColumn("rate", F.explode(F.when(F.col(varies), every).otherwise(one)))


def list_text(rows: DataFrame, group: str, item: str, order: str, separator: str = ", ") -> DataFrame:
    """Items of each group as one text, by list order (nulls last), then item."""
    s = F.struct(F.col(order).isNull().alias("late"), F.col(order).alias("o"), F.col(item).alias("v"))
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(s)), lambda x: x.v), separator).alias("items"), F.count("*").alias("n"))


def gap_text(group: Column, member: Column) -> Column:
    return F.concat(F.lit("[Known gap]\n\n"), member, F.lit(" is not classified in "), group, F.lit("."))


def siblings(rows: DataFrame, keys: list[str], text: str, order: str, parent: str = "parent_text") -> DataFrame:
    """Each row with the texts of all rows of its clause, in order; keys include the scheme, since clause numbers repeat across schemes."""
    g = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "\n").alias(parent))
    return rows.join(g, keys)


def breadcrumb_stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^\[.*?\]\n\n", "")


def extractive_answer(text: Column, path: Column, page: Column, document: Column, language: Column) -> Column:
    """Quote of a chunk with its place; ``document`` is null for the draft policy."""
    en = F.when(document.isNull(), "According to the draft policy").otherwise(F.concat(F.lit("According to "), document))
    hi = F.when(document.isNull(), "प्रारूप नीति के अनुसार").otherwise(F.concat(document, F.lit(" के अनुसार")))
    where = F.concat(F.lit(" ("), F.coalesce(path, F.lit("")), F.when(F.coalesce(page, F.lit(0)) > 0, F.concat(F.lit(", p."), page.cast("string"))).otherwise(F.lit("")), F.lit("): "))
    return F.concat(F.when(language == "hi", hi).otherwise(en), where, breadcrumb_stripped(text))


def sections_of_rules(rule_ids: Column, scheme: Column) -> Column:
    """Sections of rule ids like SCHEME-S9.1-a, the first of equal ones in order."""
    core = lambda r: F.when(r.startswith(F.concat(scheme, F.lit("-S"))), F.substring(r, F.length(scheme) + 3, F.length(r))).otherwise(r)
    return F.array_distinct(F.transform(rule_ids, lambda r: F.regexp_replace(core(r), "-[^-]*$", "")))


def local_ids(ids: Column, scheme: Column) -> Column:
    return F.transform(ids, lambda a: F.when(a.startswith(F.concat(scheme, F.lit("-"))), F.substring(a, F.length(scheme) + 2, F.length(a))).otherwise(a))


def citation_header(document: Column, path: Column, page: Column) -> Column:
    """[document > path > p.n] with the page left out where there is none."""
    return F.concat(F.lit("["), document, F.lit(" > "), path, F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(" > p."), page.cast("string"))).otherwise(F.lit("")), F.lit("]"))


def with_scheme(rows: DataFrame, schemes: DataFrame) -> DataFrame:
    """Rows with version, status and label of their scheme (scheme_id, version, status, name, short_name); an unknown one has version v1, no status, and its id as label."""
    known = schemes.select("scheme_id", F.col("version").alias("__v"), F.upper("status").alias("__s"), F.coalesce(F.nullif("name", F.lit("")), F.nullif("short_name", F.lit(""))).alias("__n"))
    out = rows.join(known, "scheme_id", "left")
    return out.withColumns({"source_version": F.coalesce(F.nullif("__v", F.lit("")), F.lit("v1")), "source_status": F.coalesce("__s", F.lit("")), "label": F.coalesce("__n", "scheme_id")}).drop("__v", "__s", "__n")


def version_slug(version: Column) -> Column:
    short = F.substring(F.regexp_replace(F.regexp_replace(F.trim(version), r"[\s,]+", "_"), r"[^A-Za-z0-9._-]", ""), 1, 40)
    return F.lower(F.coalesce(F.nullif(F.regexp_replace(short, "_+$", ""), F.lit("")), F.lit("v")))


def notes_text(sections: Column, flags: Column) -> Column:
    """The sentences on governing conditions and open questions, each only where there are any."""
    said = lambda lead, items: F.when(F.size(items) > 0, F.concat(F.lit(lead), F.array_join(items, ", "), F.lit("."))).otherwise(F.lit(""))
    return F.concat(said(" Governing conditions: section(s) ", sections), said(" Known open questions on this incentive: ", flags))


def incentive_chunks(incentives: DataFrame, schemes: DataFrame) -> DataFrame:
    """One chunk for each incentive without a rate by category: its ``other`` rate, else the first.

    incentives: incentive_id, scheme_id, name, item_no, page, rates (category, rate_text), rule_ids, flags.
    """
    slug = F.regexp_replace(F.lower("name"), "[ /]", "_")
    rows = with_scheme(incentives, schemes).withColumns({"sections": sections_of_rules(F.col("rule_ids"), F.col("scheme_id")), "local_flags": local_ids(F.col("flags"), F.col("scheme_id"))})
    item = F.when(F.coalesce("item_no", F.lit("")) != "", F.concat(F.lit("Item "), F.col("item_no"), F.lit(" "), F.col("name"))).otherwise(F.col("name"))
    other = F.get(F.filter("rates", lambda r: r.category == "other"), F.lit(0)).getField("rate_text")
    rate = F.coalesce(F.nullif(other, F.lit("")), F.get("rates", F.lit(0)).getField("rate_text"), F.lit(""))
    only = (F.size("rates") > 0) & F.forall("rates", lambda r: r.category == "other")
    text = F.concat(citation_header(F.col("label"), item, F.col("page")), F.lit("\n\n"), F.col("name"), F.lit(": "), rate, F.lit("."), notes_text(F.col("sections"), F.col("local_flags")))
    return rows.select(F.concat(F.lower("scheme_id"), F.lit("."), version_slug(F.col("source_version")), F.lit(".incentive."), slug).alias("chunk_id"), "incentive_id", item.alias("clause_path"), F.when(only, "other").otherwise("micro,small,medium").alias("categories"), F.array_join("sections", ",").alias("sections"), F.array_join("local_flags", ",").alias("flags"), "source_status", text.alias("text"))


def list_chunks(rows: DataFrame, group: str, item: str, order: str, header: Column, lead: Column, note: Column) -> DataFrame:
    """One chunk for each list (districts of a region, sectors, clusters): header, lead, the items in order, note."""
    listed = list_text(rows, group, item, order)
    return listed.select(group, F.concat(header, F.lit("\n\n"), lead, F.col("items"), F.lit("."), note).alias("text"))


def every_gap(universe: DataFrame, present: DataFrame, group: str, member: str) -> DataFrame:
    """A chunk for every missing member of every group."""
    gaps = universe.join(present, [group, member], "left_anti")
    return gaps.select(group, member, gap_text(F.col(group).cast("string"), F.col(member).cast("string")).alias("text"))


def prompt_message(sources: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, message): numbered sources in the order of their tags, then the question.

    sources: query_id, position, clause_path, page, text; a question without sources has an empty block.
    """
    block = F.concat(F.lit("[S"), F.col("position").cast("string"), F.lit("] "), F.col("clause_path"), F.lit(" (p."), F.coalesce(F.col("page").cast("string"), F.lit("None")), F.lit(")\n"), F.col("text"))
    blocks = sources.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", block.alias("b")))), lambda x: x.b), "\n\n").alias("blocks"))
    return questions.join(blocks, "query_id", "left").select("query_id", F.concat(F.lit("SOURCES\n"), F.coalesce("blocks", F.lit("")), F.lit("\n\nQUESTION\n"), F.col("text")).alias("message"))


def checked_fields(records: DataFrame) -> DataFrame:
    """(label, text) whose figures must stand in the source: every rate of an incentive, the condition of a rule, nothing else.

    records: entity_type, id, condition_text, rates (category, rate_text).
    """
    rates = F.transform("rates", lambda r: F.struct(F.concat(F.col("id"), F.lit(" ["), r.category, F.lit("]")).alias("label"), F.coalesce(r.rate_text, F.lit("")).alias("text")))
    rule = F.array(F.struct(F.col("id").alias("label"), F.coalesce("condition_text", F.lit("")).alias("text")))
    return records.select(F.explode(F.when(F.col("entity_type") == "incentive", rates).when(F.col("entity_type") == "eligibility_rule", rule)).alias("f")).select("f.label", "f.text")
