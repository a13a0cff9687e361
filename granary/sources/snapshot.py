"""Versioned sets of tables: all of a set is published at once or not at all.

A write puts every table into a folder of its own and then publishes one small manifest, which names
the tables of the version, by a rename that fails if the name is taken. Readers list the manifests, take the
last one (or a given version) and read the folders that it names; folders without a manifest don't exist for them.
So a driver or executor that dies midway, a failing table or a lost race leave the earlier version
as it was, and a reader that has begun keeps its files. A table that isn't given is taken over
from the version before by name, without a copy.

Manifests are numbered from 0 without gaps. Row counts are observed while the tables are written.
The rename must be atomic in the store, as on HDFS and local disks.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFESTS = "_manifests"


class Conflict(RuntimeError):
    """Another writer has published first."""


class Rejected(ValueError):
    """Error frames (``names``) have rows; nothing was written."""

    def __init__(self, names: list[str]):
        super().__init__(f"errors in {', '.join(names)}")
        self.names = names


@dataclass(frozen=True)
class Manifest:
    version: int
    tables: dict[str, dict]


def hadoop(spark: SparkSession, folder: str):
    """(file system, function that makes a path)."""
    jvm = spark.sparkContext._jvm
    make = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return make(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def versions(spark: SparkSession, folder: str) -> list[int]:
    fs, path = hadoop(spark, folder)
    at = path(f"{folder}/{MANIFESTS}")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> Manifest | None:
    """The last manifest, or that of a version; None if there is none."""
    known = versions(spark, folder)
    if not known or version is not None and version not in known:
        return None
    version = known[-1] if version is None else version
    fs, path = hadoop(spark, folder)
    stream = fs.open(path(f"{folder}/{MANIFESTS}/{version:012d}.json"))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(version, json.loads(text)["tables"])


def publish(spark: SparkSession, folder: str, version: int, tables: dict[str, dict]) -> Manifest:
    """Make a version visible; Conflict if it exists."""
    fs, path = hadoop(spark, folder)
    fs.mkdirs(path(f"{folder}/{MANIFESTS}"))
    draft, target = path(f"{folder}/{MANIFESTS}/.{uuid.uuid4().hex}.tmp"), path(f"{folder}/{MANIFESTS}/{version:012d}.json")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps({"version": version, "tables": tables}, sort_keys=True).encode()))
    finally:
        out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kinds = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    kinds[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), kinds)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(target):
            raise Conflict(f"version {version} of {folder} exists") from e
        raise
    return Manifest(version, tables)


def write(frames: dict[str, DataFrame], folder: str, errors: dict[str, DataFrame] | None = None, expected: int | None = None, keep: bool = True) -> Manifest:
    """Publish the frames as the next version.

    Rejected if an error frame has a row (each is asked for one row, not counted). ``expected`` is the version
    that the frames were made from (-1: none); Conflict if another has been published since. With
    ``keep``, tables of the version before that aren't given stay in the set.
    """
    spark = next(iter(frames.values())).sparkSession
    bad = [name for name, e in (errors or {}).items() if not e.isEmpty()]
    if bad:
        raise Rejected(sorted(bad))
    before = manifest(spark, folder)
    at = before.version if before else -1
    if expected is not None and expected != at:
        raise Conflict(f"{folder} is at version {at}, not {expected}")
    tables = dict(before.tables) if before and keep else {}
    for name, df in frames.items():
        seen = Observation()
        place = f"data/{name}-{uuid.uuid4().hex}"
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{folder}/{place}")
        tables[name] = {"path": place, "rows": seen.get["rows"], "schema": df.schema.jsonValue()}
    return publish(spark, folder, at + 1, tables)


def read(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the last (or a given) version by name; an unpublished folder has none."""
    m = manifest(spark, folder, version)
    return {n: spark.read.schema(StructType.fromJson(t["schema"])).parquet(f"{folder}/{t['path']}") for n, t in (m.tables if m else {}).items()}


def complete(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether the last version's files of a table are there: its folder holds the writer's mark of success."""
    m = manifest(spark, folder)
    fs, path = hadoop(spark, folder)
    return bool(m and name in m.tables and fs.exists(path(f"{folder}/{m.tables[name]['path']}/_SUCCESS")))


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; only where that is unset a temporary one."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = tempfile.mkdtemp(prefix="granary-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared}/snapshot-{uuid.uuid4().hex}"


def expire(spark: SparkSession, folder: str, last: int = 1) -> list[str]:
    """Drop manifests but the ``last`` ones, then folders that no manifest names; not to be run while a write is under way."""
    fs, path = hadoop(spark, folder)
    for v in versions(spark, folder)[:-last]:
        fs.delete(path(f"{folder}/{MANIFESTS}/{v:012d}.json"), False)
    used = {t["path"] for v in versions(spark, folder) for t in manifest(spark, folder, v).tables.values()}
    data = path(f"{folder}/data")
    gone = [f"data/{s.getPath().getName()}" for s in fs.listStatus(data)] if fs.exists(data) else []
    gone = sorted(p for p in gone if p not in used)
    for p in gone:
        fs.delete(path(f"{folder}/{p}"), True)
    return gone
