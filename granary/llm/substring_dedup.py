"""Substring dedup by seed and extend: winnowed anchors, extension on words, maximal repeats, exact removal.

A window is ``WINDOW`` consecutive words of one document; a window of a document is a repeat if its
word sequence also starts in a document with a smaller doc_id, and every word that a repeat covers
goes. Each window has one anchor, the run of ``SEED`` words in it with the smallest hash (the first
of equals), so equal windows have equal anchors at equal offsets. An anchor's context is all the words
of the windows that have it; the windows of an anchor are consecutive. The steps:

1. Seeds: anchors with their contexts' hashes are written once, and those that two or more documents
   have are kept. Occurrences with an equal anchor and an equal context (64 bits of the anchor's words,
   64 bits by an unrelated function of the bytes of the context) are one class; those outside the
   class's document with the smallest id are repeats as a whole.
2. Extension: an anchor that several classes of several documents share is open. Each class joins
   the first class of its anchor, and the match is extended word by word from the anchor to the left
   and to the right. Windows inside the match repeat the first class's document.
3. Windows of open anchors outside that match are compared by their words with the document of the
   smallest id that has them.
4. Neighbouring repeats with the same source merge into maximal repeats (start, length, source).

Cost at scale: the texts move once, into a table bucketed by row in the shared scratch folder, so the
later joins of texts with small per-row replies move the replies alone. Anchors are looked up in
``ROUNDS`` ranges of their hash, one after another, which divides the scratch space of that step. Minima
are taken before the shuffle. A class or anchor joins one row, so pairs of documents are never made and an anchor in a
third of all documents costs one row for each; hot keys (``join_keyed``), whose number is bounded, are broadcast instead of shuffled (a row has at most about 1.3 kB,
as longer words count by their SHA-256).

A null text has no words. doc_id may have any type that has an order; a null one counts as larger
than any other, and rows that share a doc_id are one document for the comparison but get a row each
(rows equal in doc_id and text alike get the same result). An empty table gives an empty result. Only
doc_id and text are read, so extra columns, whatever their names, are not part of the result.
"""

from __future__ import annotations

import atexit
import functools
import gc
import hashlib
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, join_keyed, materialize, read_table, release, scratch_dir, text_bytes
from .wordhash import Hasher, U, groups

WINDOW, SEED, ROUNDS = 13, 5, 4
#: Words of more bytes count by their SHA-256 in extensions, which bounds a context.
LONG_WORD = 64


def first_least(x: np.ndarray, width: int) -> np.ndarray:
    """Offset of the least of each ``width`` consecutive numbers by all but their lowest bits, the first of equals."""
    bits = U((1 << max(1, (width - 1).bit_length())) - 1)
    high, n = x & ~bits, len(x) - width + 1
    best = high[:n].copy()
    for j in range(1, width):
        np.minimum(best, high[j : j + n] | U(j), out=best)
    return (best & bits).astype(np.int64)


class Seeds:
    """Anchors of a group of texts: (first window, number of windows, anchor's first word) as word numbers in the group."""

    def __init__(self, hasher: Hasher, texts: list[bytes], window: int = WINDOW, seed: int = SEED):
        self.window = window
        self.h, self.doc, self.start, self.end, self.buf = hasher.words(texts)
        self.n = np.bincount(self.doc, minlength=len(texts))
        self.base = np.r_[0, np.cumsum(self.n)][:-1]  # first word of each text
        size = len(self.h)
        self.lead = self.count = self.anchor = np.zeros(0, np.int64)
        self.grams = np.zeros(0, np.uint64)
        if size >= window:
            at = np.arange(size - seed + 1)
            self.grams = hasher.spans(self.h, at, at + seed)
            inside = np.flatnonzero(self.doc[: size - window + 1] == self.doc[window - 1 :])
            anchor = inside + first_least(self.grams, window - seed + 1)[inside]
            if len(anchor):
                new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (self.doc[inside[1:]] != self.doc[inside[:-1]])])
                self.lead, self.anchor = inside[new], anchor[new]
                self.count = np.diff(np.r_[new, len(inside)])

    def words(self, a: int, e: int) -> list[bytes]:
        """Words [a, e), long ones by their digest (no word holds a line break)."""
        return [w if len(w) <= LONG_WORD else b"\n" + hashlib.sha256(w).hexdigest().encode() for w in (self.buf[x:y] for x, y in zip(self.start[a:e].tolist(), self.end[a:e].tolist(), strict=True))]


def over_texts(rows: DataFrame, emit, schema: str) -> DataFrame:
    """Run ``emit(seeds, batch)`` over groups of rows of each batch; it returns arrays by the names of the schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        hasher = Hasher()
        for b in batches:
            texts = b.column("text").to_pylist()
            for a, e in groups(texts):
                out = emit(Seeds(hasher, texts[a:e]), b.slice(a, e - a))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names=names)

    return rows.mapInArrow(run, schema)


def taken(b, name: str, at: np.ndarray):
    import pyarrow as pa

    return b.column(name).take(pa.array(at, pa.int64()))


def flat(lists) -> tuple[np.ndarray, object]:
    """(row, values) of a list column, null counting as empty."""
    sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64) if lists.null_count else np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def numbers(x) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(np.int64)


def emit_anchors(s: Seeds, b):
    doc = s.doc[s.lead]
    last = s.lead + s.count + s.window - 2
    buf, digest = s.buf, xxhash.xxh64_intdigest
    context = [digest(buf[x:y], 7) for x, y in zip(s.start[s.lead].tolist(), s.end[last].tolist(), strict=True)]
    return {
        "anchor": s.grams[s.anchor].view(np.int64),
        "context": np.array(context, np.uint64).view(np.int64),
        "id": taken(b, "doc_id", doc),
        "row": taken(b, "row", doc),
        "start": (s.lead - s.base[doc]).astype(np.int32),
        "n": s.count.astype(np.int8),
        "lo": (s.anchor - s.lead).astype(np.int8),
    }


def emit_contexts(s: Seeds, b):
    """The words of the contexts whose first windows are asked for."""
    import pyarrow as pa

    row, asked = flat(b.column("asked"))
    at = np.searchsorted(s.lead, s.base[row] + numbers(asked))
    doc, a, e = s.doc[s.lead[at]], s.lead[at], s.lead[at] + s.count[at] + s.window - 1
    words = [b" ".join(s.words(x, y)) for x, y in zip(a.tolist(), e.tolist(), strict=True)]
    return {
        "anchor": s.grams[s.anchor[at]].view(np.int64),
        "id": taken(b, "doc_id", doc),
        "row": taken(b, "row", doc),
        "start": (a - s.base[doc]).astype(np.int32),
        "lo": (s.anchor[at] - a).astype(np.int8),
        "words": pa.array(words, pa.binary()),
    }


def extend(own: list[bytes], at: int, other: list[bytes], other_at: int, seed: int = SEED) -> tuple[int, int]:
    """[a, e) of the words of ``own`` that go on matching ``other`` both ways from the anchor, which stands at the places given."""
    shift = other_at - at
    if own[at : at + seed] != other[other_at : other_at + seed]:
        return at, at
    a, e = at, at + seed
    low, high = max(0, -shift), min(len(own), len(other) - shift)
    while a > low and own[a - 1] == other[a - 1 + shift]:
        a -= 1
    while e < high and own[e] == other[e + shift]:
        e += 1
    return a, e


def extended(pairs: DataFrame, id_type: str, window: int = WINDOW) -> DataFrame:
    """From rows with the words of a class and of the first class of its anchor: repeats (row, start, n, source), and windows left (words not null)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at, start, n, words = [], [], [], []
            cols = [b.column(c).to_pylist() for c in ("words", "lo", "first_words", "first_lo", "start", "smaller")]
            for k, (w, lo, v, first_lo, s, smaller) in enumerate(zip(*cols, strict=True)):
                w = w.split(b" ")
                a, e = extend(w, lo, v.split(b" "), first_lo)
                inside = max(0, e - a - window + 1)  # windows within the match
                if inside and smaller:
                    at.append(k)
                    start.append(s + a)
                    n.append(inside)
                    words.append(None)
                for t in range(len(w) - window + 1):
                    if not (inside and a <= t <= e - window):
                        at.append(k)
                        start.append(s + t)
                        n.append(1)
                        words.append(b" ".join(w[t : t + window]))
            took = pa.array(at, pa.int64())
            out = [b.column("row").take(took), b.column("id").take(took), pa.array(start, pa.int32()), pa.array(n, pa.int32()), b.column("first_id").take(took), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["row", "id", "start", "n", "source", "words"])

    return pairs.mapInArrow(run, f"row long, id {id_type}, start int, n int, source {id_type}, words binary")


def emit_result(s: Seeds, b):
    import pyarrow as pa

    row, found = flat(b.column("found"))
    start, n, source = (found.field(k) for k in range(3))
    first, n = s.base[row] + numbers(start), numbers(n)
    delta = np.zeros(len(s.h) + 1, np.int64)
    np.add.at(delta, first, 1)
    np.add.at(delta, first + n + s.window - 1, -1)
    gone = np.cumsum(delta)[:-1] > 0
    removed = np.bincount(s.doc[gone], minlength=len(s.n)) if len(s.h) else np.zeros(len(s.n), np.int64)
    texts = []
    bounds = np.r_[s.base, len(s.h)]
    for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        keep = np.flatnonzero(~gone[a:e]) + a
        texts.append(b" ".join([s.buf[x:y] for x, y in zip(s.start[keep].tolist(), s.end[keep].tolist(), strict=True)]))
    # maximal repeats: windows that follow one another and have the same source
    order = np.lexsort((first, row))
    first, n, row, named = first[order], n[order], row[order], source.take(pa.array(order)).to_pylist()
    repeats: list[list[dict]] = [[] for _ in range(len(s.n))]
    for f, k, r, d in zip((first - s.base[row]).tolist(), n.tolist(), row.tolist(), named, strict=True):
        last = repeats[r][-1] if repeats[r] else None
        if last and last["source"] == d and last["start"] + last["length"] - s.window + 1 == f:
            last["length"] += k
        else:
            repeats[r].append({"start": f, "length": k + s.window - 1, "source": d})
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", source.type)]))
    return {"doc_id": b.column("doc_id"), "n_words": s.n.astype(np.int64), "n_removed": removed.astype(np.int64), "kept": pa.array(texts, pa.binary()), "repeats": pa.array(repeats, kind)}


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps; they go once nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def smaller(a: Column, b: Column) -> Column:
    """Whether document a comes before document b; null ids come last."""
    return a.isNotNull() & (b.isNull() | (a < b))


def first_and_last(by: str = "id") -> list[Column]:
    """Least and greatest id of a group (nulls aside), whether it has a null id, and its number of rows."""
    return [F.min(by).alias("least"), F.max(by).alias("most"), F.max(F.col(by).isNull()).alias("nulls"), F.count("*").alias("rows_of")]


def several() -> Column:
    """Whether a group of first_and_last() holds more than one document."""
    return F.col("least").isNotNull() & (F.col("nulls") | (F.col("least") < F.col("most")))


def seeds_of(anchors: DataFrame, rounds: int = ROUNDS) -> list[DataFrame]:
    """The anchors that stand in more than one document, in a table for each range of hashes."""
    total, out = anchors.count(), []
    for k in range(rounds):
        some = anchors.filter(F.pmod("anchor", F.lit(rounds)) == k)
        known = materialize(some.groupBy("anchor").agg(*first_and_last()).filter(several()).select("anchor", "rows_of"), "seeds")
        found = materialize(join_keyed(some, known, ["anchor"], total).drop("rows_of"), "seeded")
        release(known)
        settle(anchors.sparkSession)
        out.append(found)
    return out


class Texts:
    """The texts in a table bucketed by row, in the shared scratch folder."""

    def __init__(self, rows: DataFrame):
        spark = self.spark = rows.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.path = f"granary_texts_{uuid.uuid4().hex}", f"{scratch_dir(spark)}/texts-{uuid.uuid4().hex}"
        numbered = rows.withColumn("row", F.monotonically_increasing_id())
        numbered.repartition(n, "row").write.bucketBy(n, "row").option("path", self.path).saveAsTable(self.name)
        atexit.register(self.drop)
        self.table = spark.table(self.name)

    def with_reply(self, reply: DataFrame, how: str) -> DataFrame:
        return self.table.join(reply.hint("shuffle_hash"), "row", how)

    def drop(self) -> None:
        try:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        except Exception:  # the session may be gone at exit
            pass
        drop_path(self.spark, self.path)


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept: bytes of the kept words joined by single blanks, repeats: maximal repeats) for each row."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = Texts(docs.select("doc_id", text_bytes(text).alias("text")))
    settle(spark)

    anchors = materialize(over_texts(texts.table, emit_anchors, f"anchor long, context long, id {id_type}, row long, start int, n tinyint, lo tinyint"), "anchors")
    ranges = seeds_of(anchors)
    seeded = functools.reduce(DataFrame.unionByName, ranges)
    release(anchors)
    settle(spark)
    total = seeded.count()
    classes = materialize(seeded.groupBy("anchor", "context").agg(*first_and_last()), "classes")
    shared = classes.groupBy("anchor").agg(F.count("*").alias("classes_of")).filter("classes_of > 1").select("anchor", F.lit(True).alias("open"))
    of_open = classes.join(shared, "anchor", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    told = materialize(of_open.filter(F.col("open") | several()).select("anchor", "context", "least", "open", "rows_of"), "told-classes")
    release(classes)
    settle(spark)
    joined = join_keyed(seeded, told, ["anchor", "context"], total)
    later = smaller(F.col("least"), F.col("id"))
    placed = materialize(joined.filter(later | F.col("open")).select("row", "start", F.col("n").cast("int").alias("n"), "least", later.alias("whole")), "places")
    for t in (*ranges, told):
        release(t)
    settle(spark)

    asked = placed.filter("not whole").groupBy("row").agg(F.collect_list("start").alias("asked"))
    contexts = materialize(over_texts(texts.with_reply(asked, "inner"), emit_contexts, f"anchor long, id {id_type}, row long, start int, lo tinyint, words binary"), "contexts")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row", "start", "lo", "words")
    firsts = contexts.groupBy("anchor").agg(F.min(order).alias("f"), F.count("*").alias("rows_of"))
    firsts = materialize(firsts.filter("rows_of > 1").select("anchor", "rows_of", F.col("f.id").alias("first_id"), F.col("f.row").alias("first_row"), F.col("f.start").alias("first_start"), F.col("f.lo").alias("first_lo"), F.col("f.words").alias("first_words")), "first-classes")
    settle(spark)
    pairs = join_keyed(contexts, firsts, ["anchor"], contexts.count()).filter("row <> first_row or start <> first_start")
    pairs = pairs.select("row", "id", "start", "lo", "words", "first_id", "first_lo", "first_words", smaller(F.col("first_id"), F.col("id")).alias("smaller"))
    parts = materialize(extended(pairs, id_type), "extended")
    release(contexts)
    release(firsts)
    settle(spark)

    left = parts.filter("words is not null").select("row", "id", "start", "n", "words")
    known = materialize(left.groupBy("words").agg(*first_and_last()).filter(several()).select("words", "least", "rows_of"), "windows")
    left_repeats = join_keyed(left, known, ["words"], total).filter(smaller(F.col("least"), F.col("id"))).select("row", "start", "n", "least")
    hits = placed.filter("whole").drop("whole").unionByName(parts.filter("words is null").select("row", "start", "n", F.col("source").alias("least"))).unionByName(left_repeats)
    found = materialize(hits.groupBy("row").agg(F.collect_list(F.struct("start", "n", F.col("least").alias("source"))).alias("found")), "repeats")
    for t in (placed, parts, known):
        release(t)
    settle(spark)
    made = over_texts(texts.with_reply(found, "left"), emit_result, f"doc_id {id_type}, n_words long, n_removed long, kept binary, repeats array<struct<start:int,length:int,source:{id_type}>>")
    return made


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
