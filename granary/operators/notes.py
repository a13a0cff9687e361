"""Notes: reference index, link resolution and rewriting, directory indexes, sources, aliases, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import all_matches, collapse

#: Entity types in the order in which a bare id prefers them.
PREFERENCE = ("scheme", "incentive", "eligibility_rule", "authority", "district", "district_classification", "sector", "act", "ambiguity_flag", "glossary_term")


def normal_reference(c: Column) -> Column:
    """A reference without brackets, label, fragment, leading slash and suffix; null for external links. Relative ones keep their dots."""
    t = F.trim(F.regexp_replace(c, r"^\[\[([^\]|]*)(\|[^\]]*)?\]\]$", "$1"))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "#.*$", ""), "^/+", ""), r"\.md$", "")
    return F.when(c.rlike(r"://|^mailto:") | (F.coalesce(t, F.lit("")) == ""), F.lit(None).cast("string")).otherwise(t)


def rebase(reference: Column, base: Column) -> Column:
    """A reference that starts with ./ or ../ as a path from the root; others unchanged."""
    folder = F.filter(F.split(base, "/"), lambda x: x != "")
    folder = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - 1, F.lit(0)))
    parts = F.filter(F.split(reference, "/"), lambda x: ~x.isin("", "."))
    walk = F.aggregate(parts, folder, lambda at, x: F.when(x == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.array_append(at, x)))
    return F.when(reference.startswith("."), F.array_join(walk, "/")).otherwise(reference)


def concept_index(concepts: DataFrame) -> DataFrame:
    """concepts: concept_id, entity_type, domain_id -> (token, concept_id): the id itself, and the domain id of the preferred type."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in PREFERENCE]), F.col("entity_type")), F.lit(99))
    order = F.when(order == 0, 99).otherwise(order)
    w = W.partitionBy("domain_id").orderBy(order, "concept_id")
    bare = concepts.filter("domain_id is not null").withColumn("__r", F.row_number().over(w)).filter("__r = 1").select(F.col("domain_id").alias("token"), "concept_id")
    own = concepts.select(F.col("concept_id").alias("token"), "concept_id")
    return own.unionByName(bare.join(own.select("token"), "token", "left_anti"))


def resolve(references: DataFrame, index: DataFrame, reference: str = "reference", base: str = "base") -> DataFrame:
    """Add concept_id (null if unresolved or external)."""
    token = rebase(normal_reference(F.col(reference)), F.coalesce(F.col(base), F.lit("")))
    return references.withColumn("token", token).join(index, "token", "left")


def rewrite_wikilinks(notes: DataFrame, index: DataFrame, key: str = "path", body: str = "body") -> DataFrame:
    """Bodies with [[x]] and [[x|label]] as Markdown links to their concepts; unresolved ones stay.

    The text between links and the links are exploded in order, joined with the index and put together again.
    """
    link = r"\[\[[^\]]+\]\]"
    between = F.split(F.col(body), link)
    links = F.concat(all_matches(F.col(body), link), F.array(F.lit("")))
    parts = notes.select(key, F.posexplode(F.arrays_zip(between.alias("text"), links.alias("link")))).select(key, "pos", F.coalesce("col.text", F.lit("")).alias("text"), F.coalesce("col.link", F.lit("")).alias("link"))
    parts = parts.withColumn("token", normal_reference(F.when(F.col("link") != "", F.col("link"))))
    label = F.coalesce(F.nullif(F.trim(F.regexp_extract("link", r"\|([^\]]*)\]\]$", 1)), F.lit("")), F.col("token"))
    joined = parts.join(index, "token", "left").withColumn("out", F.concat("text", F.when(F.col("concept_id").isNotNull(), F.concat(F.lit("["), label, F.lit("](/"), F.col("concept_id"), F.lit(".md)"))).otherwise(F.col("link"))))
    return joined.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda s: s.out), "").alias(body))


def directory_index(notes: DataFrame) -> DataFrame:
    """notes: path, title -> one list of links for each folder, by title then path."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("](/"), F.col("path"), F.lit(")"))
    return notes.groupBy(folder.alias("folder")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("title", "path", line.alias("line")))), lambda s: s.line), "\n").alias("listing"), F.count("*").alias("n"))


def distinct_sources(sources: Column) -> Column:
    """Source entries (id, resource), the first of equal ones, in order."""
    return F.array_distinct(F.transform(sources, lambda s: F.struct(s.id.alias("id"), s.resource.alias("resource"))))


def distinct_aliases(*names: Column) -> Column:
    """Filled names in order, without those that differ from an earlier one in case only."""
    all_names = F.array_compact(F.array(*[F.nullif(F.trim(n), F.lit("")) for n in names]))
    low = F.transform(all_names, lambda x: F.lower(x))
    return F.filter(all_names, lambda x, k: F.array_position(low, F.lower(x)) == k + 1)


def summary(rates: Column, *fields: Column) -> Column:
    """The first three rates as one text, else the first filled field; at most 400 characters."""
    said = F.array_join(F.transform(F.slice(rates, 1, 3), lambda r: F.concat(r.category, F.lit(": "), r.rate_text)), "; ")
    first = F.coalesce(*[F.nullif(collapse(f), F.lit("")) for f in fields], F.lit(""))
    return F.left(F.when(F.coalesce(F.size(rates), F.lit(0)) > 0, said).otherwise(first), F.lit(400))


def disclosures(needed: DataFrame, register: DataFrame, language: str = "language") -> DataFrame:
    """needed: query_id, flag, language, pos; register: id, local_id, en, hi, severity -> the texts to append, and whether one blocks.

    A flag may be given by its namespaced or its local id; unknown ones are skipped.
    """
    ids = register.select(F.col("id").alias("flag"), "id", "en", "hi", "severity").unionByName(register.filter("local_id <> id").select(F.col("local_id").alias("flag"), "id", "en", "hi", "severity"))
    found = needed.join(ids, "flag").withColumn("text", F.when(F.col(language) == "hi", F.col("hi")).otherwise(F.col("en")))
    firsts = found.groupBy("query_id", "id").agg(F.min(F.struct("pos", "text", "severity")).alias("s"))
    return firsts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s.pos", "s.text"))), lambda x: x.text), "\n").alias("disclosures"), F.max(F.col("s.severity") == "blocking").alias("blocking"))


def abstain_message(language: Column, suggestions: Column, document: str) -> Column:
    en = F.concat(F.lit(f"This does not appear to be covered in {document}. Related topics: "), suggestions, F.lit("."))
    hi = F.concat(F.lit(f"यह विषय {document} में शामिल नहीं है। संबंधित विषय: "), suggestions, F.lit("।"))
    return F.when(language == "hi", hi).otherwise(en)


#: Answers of two intents that need no retrieval, in English and Hindi.
TEMPLATES = {
    "calculation_request": (
        "This assistant does not calculate individual entitlements -- it explains what the draft policy states. Based on the applicable rate and cap shown above, please contact your District Industries Centre (DIC) or the MSME helpline for a specific assessment of your case.",
        "यह सहायक व्यक्तिगत पात्रता की गणना नहीं करता -- यह केवल प्रारूप नीति में जो लिखा है वह बताता है। ऊपर दी गई लागू दर और सीमा के आधार पर, अपने विशेष मामले के आकलन के लिए कृपया अपने ज़िला उद्योग केंद्र (DIC) या एमएसएमई हेल्पलाइन से संपर्क करें।",
    ),
    "grievance": (
        "This policy establishes a dedicated helpline and this chatbot as an entry point for MSME grievances (section 7.1). Please describe your issue and it will be logged; for urgent matters, contact your District Industries Centre (DIC) directly.",
        "यह नीति एमएसएमई शिकायतों के लिए एक समर्पित हेल्पलाइन और यह चैटबॉट प्रवेश बिंदु के रूप में स्थापित करती है (धारा 7.1)। कृपया अपनी समस्या बताएं, इसे दर्ज किया जाएगा; तत्काल मामलों के लिए, सीधे अपने ज़िला उद्योग केंद्र (DIC) से संपर्क करें।",
    ),
}


def template_answer(intent: Column, language: Column) -> Column:
    """The fixed answer of an intent in Hindi for Hindi, else in English; null for other intents."""
    by_intent = [F.when(intent == k, F.when(language == "hi", hi).otherwise(en)) for k, (en, hi) in TEMPLATES.items()]
    return F.coalesce(*by_intent)


def attach_findings(nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """Nodes with their sorted finding ids: a finding names a node by its title (in any case), else by its domain id.

    nodes: concept_id, title, domain_id; findings: finding_id, names. A title that several nodes have
    belongs to the first of them by concept_id.
    """
    first = lambda key: nodes.filter(key.isNotNull()).groupBy(key.alias("name")).agg(F.min("concept_id").alias("concept_id"))
    by_title = first(F.lower("title"))
    by_id = first(F.lower("domain_id")).join(by_title, "name", "left_anti")
    found = findings.withColumn("name", F.lower("names")).join(by_title.unionByName(by_id), "name")
    lists = found.groupBy("concept_id").agg(F.array_sort(F.collect_set("finding_id")).alias("finding_ids"))
    return nodes.join(lists, "concept_id", "left").withColumn("finding_ids", F.coalesce("finding_ids", F.array().cast("array<string>")))


def evidence(entries: DataFrame, walked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rollup of a walk: distinct chunk, ambiguity and finding ids in the order of the nodes, and entries that are no node.

    entries: query_id, concept_id; walked: query_id, concept_id, position; nodes: concept_id, entity_type,
    domain_id, chunk_ids, finding_ids (arrays of strings). One row for each query of ``entries``.
    """
    told = walked.select("query_id", "concept_id", "position").join(nodes, "concept_id")
    parts = F.concat(
        F.transform("chunk_ids", lambda c: F.struct(F.lit("chunk").alias("kind"), c.alias("id"))),
        F.when(F.col("entity_type") == "ambiguity_flag", F.array(F.struct(F.lit("ambiguity").alias("kind"), F.col("domain_id").alias("id")))).otherwise(F.array().cast("array<struct<kind:string,id:string>>")),
        F.transform("finding_ids", lambda c: F.struct(F.lit("finding").alias("kind"), c.alias("id"))),
    )
    rows = told.select("query_id", "position", F.posexplode(parts).alias("at", "p")).select("query_id", "position", "at", "p.kind", "p.id")
    missing = entries.join(nodes.select("concept_id"), "concept_id", "left_anti").select("query_id", F.lit(0).alias("position"), F.lit(0).alias("at"), F.lit("missing").alias("kind"), F.col("concept_id").alias("id"))
    firsts = rows.unionByName(missing).groupBy("query_id", "kind", "id").agg(F.min(F.struct("position", "at")).alias("o"))
    listed = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("o", "id")))), lambda x: x.id), ",")
    rolled = firsts.groupBy("query_id").agg(*[listed(k).alias(f"{k}_ids") for k in ("chunk", "ambiguity", "finding", "missing")])
    return entries.select("query_id").distinct().join(rolled, "query_id", "left").na.fill("")


def graph_answer(walked: DataFrame, answer_types: tuple[str, ...] = ("incentive", "eligibility_rule", "ambiguity_flag"), most: int = 5, fallback: int = 4) -> DataFrame:
    """Lines of a graph answer: the first answer-bearing nodes with a summary, else the first with any summary.

    walked: query_id, concept_id, entity_type, title, summary, position.
    """
    told = walked.filter(F.coalesce(F.trim("summary"), F.lit("")) != "").withColumn("bears", F.col("entity_type").isin(*answer_types))
    w = W.partitionBy("query_id")
    told = told.withColumn("any", F.max(F.col("bears").cast("int")).over(w)).filter((F.col("any") == 0) | F.col("bears"))
    told = told.withColumn("r", F.row_number().over(w.orderBy("position"))).filter(F.col("r") <= F.when(F.col("any") == 1, most).otherwise(fallback))
    line = F.concat(F.lit("- "), F.col("title"), F.lit(": "), F.col("summary"))
    return told.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda s: s.l), "\n").alias("answer"), F.count("*").alias("n"))


def empty_after_heading(text: Column, heading: str) -> Column:
    """Whether nothing but blanks and digits follows the heading on the page (false without it)."""
    rest = F.substring_index(text, heading, -1)
    return text.contains(heading) & (F.regexp_replace(rest, r"[\s\d]+", "") == "")
