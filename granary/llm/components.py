"""Connected components of a graph of any size, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); two nodes share a root if a path joins them.

    Each round every node hooks onto the neighbour (or itself) that is first in a random order drawn
    anew each round, and links are rewritten between the chosen nodes, which leaves about half of
    them; so rounds grow with the logarithm of the largest component, chains included. Minima are
    taken before the shuffle, so a node with very many links costs its task one row for each map
    task. Each round's tables are written to the shared folder: lineage stays short and a lost
    executor repeats one round at most.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    links = materialize(both, "links")
    roots = materialize(links.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    for k in range(most_rounds):
        if links.isEmpty():
            release(links)
            return roots
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("p"))  # noqa: B023, E731
        best = links.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("v"), F.least(F.col("m"), rank("a")).alias("m"))
        hook = materialize(best.select("v", "m.p"), "hooks")
        a = links.join(hook.select(F.col("v").alias("a"), F.col("p").alias("x")), "a")
        moved = a.join(hook.select(F.col("v").alias("b"), F.col("p").alias("y")), "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        next_roots = roots.join(hook.select(F.col("v").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        old = links, roots, hook
        links, roots = materialize(moved, "links"), materialize(next_roots, "roots")
        for t in old:
            release(t)
    raise RuntimeError("components did not settle")
