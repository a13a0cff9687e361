"""All queries of the reference's operators, and their SQL. Whole numbers are 64-bit in every result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compile_queries, graph_queries, ladder_queries, note_queries, quantity_queries, record_queries, render_queries, retrieval_queries


def longs(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])

    return run


MODULES = [retrieval_queries, graph_queries, record_queries, note_queries, quantity_queries, render_queries, ladder_queries, compile_queries]
QUERIES = {k: longs(f) for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}

# Searches are registered over the stated query set alone (every id divisible by 50, against all rows), the flagship by its plain name as well.
STATED = [k.removesuffix("_every50") for k in QUERIES if k.endswith("_every50")]
for known in (QUERIES, SQL):
    for k in STATED:
        known.pop(k)
    known["hybrid_rrf_top12"] = known["hybrid_rrf_top12_every50"]
