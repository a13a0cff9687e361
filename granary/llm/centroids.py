"""Centroid clustering of integer vectors: Lloyd's rounds that skip work by Hamerly's bounds.

Each vector keeps its cluster, one upper bound of the distance to its own centroid and one lower bound
of the distance to the second-nearest. When centroids move, the upper bound grows by the drift of its centroid and
the lower one shrinks by the largest drift of any other. A vector whose upper bound stays below the lower
one, or below half the distance from its centroid to the nearest other, keeps its cluster without any
distance. Otherwise its own distance is made exact, and if that doesn't settle it, all centroids are
scanned in whole numbers. Bounds are floats with a margin of 1e-9, far above their rounding; they
only decide what is skipped, so clusters equal those of a full scan.

A round reads one written table of vectors with their bounds and writes the next, without a shuffle;
then the sums of the vectors that changed cluster are added natively, a row for each cluster and task.
The driver holds centroids, their sums and counts: ``CLUSTERS`` x ``SIZE`` whole numbers at any number of vectors. A
lost executor repeats tasks that read the last table.

Edge cases: vectors that are null, of another length, or hold a null, NaN or infinity are left out;
components beyond 2 ** 27 (values beyond two million) count as 2 ** 27, so that squared distances fit 64 bits;
a null vec_id is clustered but sorted last as a starting centroid; rows that repeat a vec_id each stay,
and equal ids are tried in the order of their vectors; fewer vectors than clusters make fewer clusters;
an empty table gives an empty result; extra columns are not read. A sum of distances that doesn't fit a long is null.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, release

CLUSTERS, SIZE, SCALE, ROUNDS = 16, 64, 64, 3
MOST = 1 << 27
MARGIN = 1e-9
BOUNDS = "vec_id long, v array<int>, cluster int, was int, upper double, lower double, scanned boolean"


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): vectors of SIZE finite components as whole numbers floor(SCALE * x)."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    bound = lambda x: F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), F.floor(x).cast("double")))
    scaled = lambda x: F.greatest(F.lit(-4.0 * MOST), F.least(F.lit(4.0 * MOST), x.cast("double") * SCALE))
    return embeddings.filter((F.size(e) == SIZE) & finite).select(F.col("vec_id").cast("long"), F.transform(e, lambda x: bound(scaled(x)).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose ``1:<vec_id>`` has the smallest hashes, in that order."""
    h = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in sorted(rows, key=lambda r: (r.h is None, r.h or "", r.v))], np.int64).reshape(-1, SIZE)


class Scan:
    """Assigns vectors to centroids, with the bounds of an earlier round where there was one."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.c = centroids
        k = len(centroids)
        apart = np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(2).astype(float))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(1) / 2 if k else np.zeros(0)
        drift = np.zeros(k) if before is None else np.sqrt(((centroids - before) ** 2).sum(1).astype(float))
        self.drift = drift
        self.others = np.array([np.delete(drift, j).max(initial=0.0) for j in range(k)])  # the largest drift of any other centroid

    def full(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid (ties: the smaller number), and the distances to it and to the second-nearest."""
        d = (v * v).sum(1)[:, None] - 2 * (v @ self.c.T) + (self.c * self.c).sum(1)[None]
        best, rows = d.argmin(1), np.arange(len(v))
        own = np.sqrt(d[rows, best].astype(float))
        d[rows, best] = np.iinfo(np.int64).max
        return best, own, np.sqrt(d.min(1).astype(float)) if len(self.c) > 1 else np.full(len(v), np.inf)

    def own(self, v: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return ((v - self.c[cluster]) ** 2).sum(1)

    def again(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        cluster, upper, lower = cluster.copy(), (upper + self.drift[cluster]) * (1 + MARGIN), lower - self.others[cluster] * (1 + MARGIN)
        enough = lambda at: upper[at] < np.maximum(lower[at], self.half[cluster[at]]) * (1 - MARGIN)
        left = np.flatnonzero(~enough(slice(None)))
        upper[left] = np.sqrt(self.own(v[left], cluster[left]).astype(float))
        left = left[~enough(left)]
        cluster[left], upper[left], lower[left] = self.full(v[left])
        scanned = np.zeros(len(v), bool)
        scanned[left] = True
        return cluster, upper, lower, scanned


def matrix(column, size: int = SIZE) -> np.ndarray:
    """Rows of an Arrow column of lists of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def assign(rows: DataFrame, scan: Scan) -> DataFrame:
    """Rows of BOUNDS after a round; rows without bounds are scanned in full."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    known = "cluster" in rows.columns
    schema = rows.sparkSession.createDataFrame([], BOUNDS).schema

    def run(batches):
        kind = to_arrow_schema(schema)
        for b in batches:
            v = matrix(b.column("v"))
            if known:
                was = b.column("cluster").to_numpy().astype(np.int64)
                cluster, upper, lower, scanned = scan.again(v, was, b.column("upper").to_numpy(), b.column("lower").to_numpy())
                was = pa.array(was, pa.int32())
            else:
                (cluster, upper, lower), scanned, was = scan.full(v), np.ones(len(v), bool), pa.nulls(len(v), pa.int32())
            made = [b.column("vec_id"), b.column("v"), pa.array(cluster.astype(np.int32)), was, pa.array(upper), pa.array(lower), pa.array(scanned)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(made, kind, strict=True)], schema=kind)

    return rows.mapInArrow(run, schema)


def moves(table: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What each cluster's sum and count gain by the vectors that changed cluster."""
    moved = table.filter(F.col("was").isNull() | (F.col("was") != F.col("cluster")))
    signed = moved.select("v", F.explode(F.filter(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("s")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("s"))), lambda x: x["c"].isNotNull())).alias("m"))
    sums = [F.sum(F.col("v")[i].cast("long") * F.col("m.s")).alias(f"s{i}") for i in range(SIZE)]
    total, count = np.zeros((k, SIZE), object), np.zeros(k, object)
    for r in signed.groupBy("m.c").agg(F.sum("m.s").alias("n"), *sums).collect():
        total[r.c], count[r.c] = [r[f"s{i}"] for i in range(SIZE)], r.n
    return total, count


def hamerly(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seen: list[int] | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, ...) after ``rounds`` rounds and a last assignment, and the last centroids.

    ``seen`` gets the number of full scans of each assignment.
    """
    c = first_centroids(vectors, k)
    total, count = np.zeros((len(c), SIZE), object), np.zeros(len(c), object)
    table, before = vectors, None
    for r in range(rounds + 1):
        done = materialize(assign(table, Scan(c, before)), "bounds")
        if table is not vectors:
            release(table)
        table = done
        if seen is not None:
            seen.append(table.filter("scanned").count())
        if r < rounds:
            more, n = moves(table, len(c))
            total, count, before = total + more, count + n, c
            c = np.array([[int(s) // int(n) for s in row] if n else list(old) for row, n, old in zip(total, count, c, strict=True)], np.int64).reshape(-1, SIZE)
    return table, c


def with_distance(table: DataFrame, c: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): the squared distance to the own centroid."""
    import pyarrow as pa

    scan = Scan(c)

    def run(batches):
        for b in batches:
            d = scan.own(matrix(b.column("v")), b.column("cluster").to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    return table.select("vec_id", "v", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long")


def pick(values: list, kind: str) -> Column:
    """The value of the row's cluster from a list of CLUSTERS values at most."""
    return F.array(*[F.lit(v).cast(kind) for v in values])[F.col("cluster")]


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that is kept."""
    vectors = materialize(whole_vectors(embeddings), "vectors")
    table, c = hamerly(vectors, k, rounds)
    release(vectors)
    found = materialize(with_distance(table, c), "distances")
    release(table)
    per = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fit = lambda n: int(n) if n < 1 << 63 else None
    inertia = [fit(per.get(j, 0)) for j in range(max(1, len(c)))]
    hashes = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()] or [None]
    return found.withColumns({"cluster_inertia": pick(inertia, "long"), "inertia": F.lit(fit(sum(per.values()))).cast("long"), "centroid_sha256": pick(hashes, "string")})


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read_table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    parts = [
        f"""x AS (SELECT vec_id, i, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM embeddings, range(1, {SIZE + 1}) t(i)
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0)""",
        f"c0 AS (SELECT s.c, x.i, x.x FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM x) QUALIFY c < {CLUSTERS}) s JOIN x USING (vec_id))",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT x.vec_id, k.c, sum((x.x - k.x) * (x.x - k.x)) AS d FROM x JOIN c{r} k USING (i) GROUP BY ALL) GROUP BY vec_id)""")
        parts.append(f"""c{r + 1} AS (SELECT k.c, k.i, coalesce(CAST((m.s - (((m.s % m.n) + m.n) % m.n)) // m.n AS BIGINT), k.x) AS x FROM c{r} k
  LEFT JOIN (SELECT a.c, x.i, sum(x.x) AS s, count(*) AS n FROM a{r} a JOIN x USING (vec_id) GROUP BY ALL) m USING (c, i))""")
    return f"""WITH {', '.join(parts[:-1])}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h.sha AS centroid_sha256
FROM a{ROUNDS} a JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS sha FROM c{ROUNDS} GROUP BY c) h ON h.c = a.c"""


ORACLE = oracle()
