"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space; bytes.split() cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where it is unset (local runs, tests) a temporary folder is made and set.
    """
    set_dir = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        set_dir = tempfile.mkdtemp(prefix="granary-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def free_name(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder is scratch space then
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared scratch folder and read it back.

    Cuts lineage without tying results to one executor's disk. The folder goes when the driver exits.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(drop_path, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing will read again."""
    if path := getattr(df, "_granary_path", None):
        drop_path(df.sparkSession, path)


def held_out() -> Column:
    """Rows whose labels are never learnt: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


#: Bytes of text that a Python worker handles at a time, beyond which a batch of rows is cut (a row is never cut).
BATCH_BYTES = 8 << 20


def slices(sizes: list[int], most: int = BATCH_BYTES) -> list[tuple[int, int]]:
    """Cut rows of the given sizes into consecutive ranges (start, length) of about ``most`` bytes."""
    out, start, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            out.append((start, k - start))
            start, total = k, 0
        total += n
    return out + ([(start, len(sizes) - start)] if len(sizes) > start else [])


def map_rows(df: DataFrame, inputs: list[str], fn, new: dict[str, str], keep: list[str] | None = None, most: int = BATCH_BYTES) -> DataFrame:
    """Add or replace the columns ``new`` (name: type) by ``fn``, which gets a list of values of each input column.

    Rows pass in Arrow batches and all other columns pass through as they are, so nulls and wide
    integers survive. ``keep`` names the columns to pass through (default: all). ``fn`` gets rows of
    about ``most`` bytes of the first input at a time.
    """
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    keep = df.columns if keep is None else keep
    df = df.select(*dict.fromkeys([*keep, *inputs]))
    types = {k: _parse_datatype_string(t) for k, t in new.items()}
    passed = [c for c in keep if c.lower() not in {n.lower() for n in new}]
    schema = StructType([df.schema[c] for c in passed] + [StructField(n, t) for n, t in types.items()])

    def run(batches):
        arrow = {n: to_arrow_type(t) for n, t in types.items()}
        for whole in batches:
            col = whole.column(inputs[0])
            sizes = [max(1, n or 0) for n in pa.compute.binary_length(col).to_pylist()] if pa.types.is_string(col.type) or pa.types.is_binary(col.type) else [1] * len(col)
            for start, n in slices(sizes, most):
                b = whole.slice(start, n)
                made = fn(*[b.column(c).to_pylist() for c in inputs])
                arrays = [b.column(c) for c in passed] + [x if isinstance(x := made[c], pa.Array) and x.type == arrow[c] else pa.array(x, arrow[c]) for c in new]
                yield pa.RecordBatch.from_arrays(arrays, names=[*passed, *new])

    return df.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` labelled documents (doc_id, text, y) that may be learnt from; y is 0.0 or 1.0.

    The sample is the first ``most`` ids in the order of their hash, so it does not depend on
    partitioning. A document with several labels takes their mean, at 0.5 or more 1. The ids are
    broadcast: their number is bounded by ``most``. Of rows that share an id the smallest text counts.
    """
    y = (F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("y")
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(y)
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    joined = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return joined.groupBy("doc_id", "y").agg(F.min(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))


#: Keys with more rows than this and than 1 / HOT_KEYS of all rows are hot.
HOT_ROWS, HOT_KEYS = 10_000, 2_000


def join_keyed(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of rows with the one row that ``table`` has for each key, with the number ``rows_of`` of rows of the key.

    Hot keys are broadcast: keys with over 1 / HOT_KEYS of ``total`` rows number less than HOT_KEYS.
    """
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(table.filter(F.col("rows_of") > bound))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(table.filter(F.col("rows_of") <= bound).hint("shuffle_hash"), keys)
    return cold.unionByName(rows.join(hot, keys))


def give_back() -> None:
    """Hand memory that numpy and Arrow have freed back to the system; workers are kept for later stages, which would add theirs to it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


class Memo(dict):
    """A function's values by argument, emptied when it holds ``most``."""

    def __init__(self, fn, most: int = 200_000):
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.fn(key)
        return value
