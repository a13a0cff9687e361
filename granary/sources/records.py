"""Compiled records, extracted pages and chunk files, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse

PROVENANCE = "struct<source_id:string,source_url:string,source_document_version:string,fetch_date:string,fetch_method:string,extraction_method:string,page_or_section_ref:string,page_start:int,page_end:int,verification_status:string,verified_by:string,verified_at:string,checksum:string>"
#: Declared schemas by entity type; dates stay strings as written, open parameters are JSON text.
SCHEMAS = {
    "scheme": f"scheme_id string, name string, short_name string, issuing_authority_id string, level string, status string, effective_from string, effective_to string, tier string, legal_basis array<string>, supersedes string, summary string, source {PROVENANCE}, cross_references array<string>",
    "incentive": f"incentive_id string, scheme_id string, name string, item_no string, incentive_type string, category_rates array<struct<enterprise_category:string,rate_text:string,rate_value:double,cap_value:double,cap_unit:string>>, varies_by_category boolean, district_scope array<string>, sector_scope array<string>, eligibility_rule_ids array<string>, ambiguity_flags array<string>, status string, source {PROVENANCE}, cross_references array<string>",
    "eligibility_rule": f"rule_id string, applies_to array<string>, condition_text string, condition_type string, parameters string, clause_ref string, section_title string, letter string, ambiguity_flags array<string>, source {PROVENANCE}, cross_references array<string>",
    "authority": f"authority_id string, name string, type string, jurisdiction array<string>, contact struct<helpline:string,email:string,portal_url:string>, source {PROVENANCE}, cross_references array<string>",
    "district": f"district_id string, name string, state string, source {PROVENANCE}",
    "district_classification": f"classification_id string, district_id string, scheme_id string, category string, basis string, list_order int, source {PROVENANCE}, cross_references array<string>",
    "sector": f"sector_id string, name string, classification_type string, scheme_id string, nic_codes array<string>, list_order int, source {PROVENANCE}",
    "glossary_term": f"term_id string, term string, definitions array<struct<scheme_id:string,definition_text:string,source:{PROVENANCE}>>, cross_scheme_conflict boolean, list_order int",
    "ambiguity_flag": "id string, local_id string, scope string, source_ids array<string>, clause_refs array<string>, page_refs array<int>, issue_type string, severity string, description string, public_disclosure_en string, public_disclosure_hi string, status string, resolution string, resolved_by string, resolved_at string, supersedes_version string, cross_references array<string>",
    "act": f"act_id string, name string, jurisdiction string, sections array<struct<section_no:string,title:string,text_summary:string,source:{PROVENANCE}>>, cross_references array<string>",
}


def read_records(spark: SparkSession, folder: str, entity: str) -> DataFrame:
    """Records of one type; a missing folder is empty, a bad file is skipped."""
    schema = SCHEMAS[entity]
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{folder}/{entity}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_records(records: DataFrame, folder: str) -> None:
    """One folder per entity type; only the types written are replaced."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("entity_type").json(folder)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, text) of an extracted document, blanks collapsed."""
    doc = spark.read.schema("pages array<struct<page_number:int,char_count:int,text:string>>").option("multiLine", True).json(path)
    return doc.select(F.explode("pages").alias("p")).select(F.col("p.page_number").alias("page"), collapse(F.col("p.text")).alias("text"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    schema = "chunks array<struct<chunk_id:string,chunk_type:string,text:string,parent_text:string,clause_path:string,page_start:int,page_end:int,scheme_id:string,source_type:string,entity_id:string,ambiguity_flags:array<string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("chunks").alias("c")).select("c.*")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk sink: a repeated id is an error and nothing is written."""
    twice = chunks.groupBy("chunk_id").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated chunk ids: {sorted(r.chunk_id for r in twice)}")
    chunks.write.mode("overwrite").parquet(path)


def join_spans(spans: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Rebuild lines of a page from (page, x, y, text): spans of a line by x, a letter doubled at a seam dropped."""
    line = spans.withColumn("row", F.round(F.col("y") / tolerance).cast("long"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda s: s.text)
    seam = lambda a, t: F.when((a != "") & (t != "") & (F.right(a, F.lit(1)) == F.left(t, F.lit(1))), F.concat(a, F.substring(t, 2, 1 << 30))).otherwise(F.concat(a, t))
    return line.groupBy("page", "row").agg(F.aggregate(parts, F.lit(""), seam).alias("line"))


def extract_pages(spark: SparkSession, folder: str, extractor, pattern: str = "*.pdf") -> DataFrame:
    """(path, page, text) of binary documents; ``extractor`` turns a document's bytes into page texts, in Python workers.

    The library that reads a format is the caller's: none is bundled. An unreadable document gives one
    row with a null page and the error as its text.
    """

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, k + 1, t) for k, t in enumerate(extractor(bytes(content)))]
                except Exception as e:  # a broken document must not end the scan
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page", "text"]).astype({"page": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, page long, text string")


def write_index(chunks: DataFrame, path: str) -> None:
    """Vector index: chunks with dense (array<float>) and sparse (map<int,float>) columns, replaced as a whole.

    Search is exact, so the index is the table itself; postings are exploded beside it for the sparse side.
    """
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    chunks.select("chunk_id", F.explode("sparse").alias("token", "weight")).write.mode("overwrite").parquet(f"{path}/postings")


def source_registry(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, name, tier, url, fetch_strategy, compliance_checked, robots) from a JSON registry; entries without an id are left out."""
    schema = "sources array<struct<source_id:string,name:string,tier:string,url:string,fetch_strategy:string,compliance_checked:boolean,robots:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("sources")).filter("source_id is not null")
