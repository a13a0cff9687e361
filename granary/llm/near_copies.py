"""Near copies by exact Jaccard similarity of sets of word shingles.

Shingles are those of SimHash (A-Z lower-cased, words are runs without ASCII white space, a text of
fewer words than a shingle is one shingle), here ``SHINGLE`` words long and taken as a set of XXH64
hashes. Two texts are near copies if the Jaccard similarity of their sets is ``LEAST`` or more; texts
without words are copies of each other. Groups are the connected components of these links.

1. Texts with the same set are handled once.
2. SimHash proposes the pairs of texts whose fingerprints over these shingles differ in ``MOST`` bits or
   fewer, by ``simhash.link`` (generalised pigeonhole, probe and verify).
3. Most pairs at 0.8 lie further apart than any distance that can be probed cheaply (README). So each set
   also gets BANDS keys, each made of WIDTH minima under fixed permutations. Texts of similarity s share a
   key with probability 1 - (1 - s**WIDTH)**BANDS, which is 0.999997 at 0.8.
4. Texts under one key are compared there by sketches, the low bytes of their BANDS * WIDTH minima: a pair
   stays if AGREE or more are equal. At 0.8 that fails for about three pairs in a million; texts that share
   boilerplate also share keys, but their sketches differ, so they form no group. A pair at 0.8 is missed only
   if it shares no key or its sketches disagree, and its fingerprints are apart. Keys of many texts are compared
   in blocks of about ``SKETCHES``. The search goes breadth first, so near copies of one text cost one pass.
5. Texts that either proposes, also through others, are a candidate group. All pairs of a group are
   compared by exact Jaccard, in blocks of at most about ``BLOCK`` texts, pairs of blocks in different tasks.
   From a block come star links (each member to the first of its cluster), never all pairs.

Null texts, null ids, repeated rows, empty tables and extra columns are handled as ``simhash.dedup`` does.
"""

from __future__ import annotations

import itertools

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, give_back, join_keyed, map_rows, materialize, text_bytes
from .components import connected_components
from .simhash import MOST, fingerprint, link

SHINGLE, LEAST, SEED = 5, 0.8, 42
BANDS, WIDTH = 32, 5
BLOCK, COLUMNS = 512, 4096
#: Equal minima (of BANDS * WIDTH) that a candidate pair has, and sketches in a block.
AGREE, SKETCHES = 104, 4096
#: Bytes of text whose sets are made at a time.
KEY_BYTES = 2 << 20
_draw = np.random.default_rng(SEED)
XOR = _draw.integers(0, 1 << 64, BANDS * WIDTH, dtype=np.uint64)
FACTOR = _draw.integers(0, 1 << 64, BANDS * WIDTH, dtype=np.uint64) | np.uint64(1)


def shingle_set(b: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in UTF-8."""
    words = b.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k, digest, join = min(shingle, len(words)), xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([digest(join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)], np.uint64))


def minima(s: np.ndarray) -> np.ndarray:
    """Least value of a set under each of BANDS * WIDTH fixed permutations."""
    low = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max)
    for at in range(0, len(s), COLUMNS):
        h = s[at : at + COLUMNS]
        low = np.minimum(low, ((h[None, :] ^ XOR[:, None]) * FACTOR[:, None]).min(axis=1))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """BANDS signed 64-bit keys from the minima of a set."""
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, WIDTH))], np.uint64).view(np.int64)


def sketch(low: np.ndarray) -> bytes:
    """Low bytes of the minima; those of different shingles are equal once in 256."""
    return low.astype(np.uint8).tobytes()


def add_keys(docs: DataFrame, raw: str, key: str, bands: str, made: str, fp: str, shingle: int) -> DataFrame:
    """Add the hash of the set, its band keys and sketch (an empty set has none) and the SimHash fingerprint."""

    def run(texts):
        sets = [shingle_set(t or b"", shingle) for t in texts]
        lows = [minima(s) if len(s) else None for s in sets]
        prints = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64).view(np.int64)
        give_back()
        return {
            key: np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64),
            bands: [[] if x is None else band_keys(x) for x in lows],
            made: [b"" if x is None else sketch(x) for x in lows],
            fp: prints,
        }

    return map_rows(docs, [raw], run, {key: "long", bands: "array<long>", made: "binary", fp: "long"}, most=KEY_BYTES)


def print_links(firsts: DataFrame, most: int = MOST) -> DataFrame:
    """Links (a, b) between keys, from rows (key, fp): equal fingerprints and those that SimHash links."""
    lows = materialize(firsts.groupBy("fp").agg(F.min("key").alias("low")), "distinct-prints")
    equal = firsts.join(lows, "fp").filter("low <> key").select(F.col("low").alias("a"), F.col("key").alias("b"))
    a, b = (lows.select(F.col("fp").alias(c), F.col("low").alias(f"low_{c}")) for c in "ab")
    near = link(lows.select("fp"), most).join(a, "a").join(b, "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))
    return equal.union(near)


def similar(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Matrix of the pairs with Jaccard similarity of ``least`` or more; shared hashes are counted exactly."""
    size = np.array([len(s) for s in sets])
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    of = np.repeat(np.arange(len(sets)), size)
    both = np.zeros((len(sets), len(sets)), np.float32)
    of, col = of[count[at] > 1], shared[at[count[at] > 1]]
    order = np.argsort(col, kind="stable")
    of, col = of[order], col[order]
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        a, b = np.searchsorted(col, [start, start + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[of[a:b], col[a:b] - start] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    # whole numbers decide, so that 4 of 5 is 0.8
    return both * 1_000_000 >= round(least * 1_000_000) * (size[:, None] + size[None, :] - both)


def block_links(ids: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Star links of the clusters that similar pairs make."""
    m = similar(sets, least)
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(m, label[None, :], len(ids)).min(axis=1))
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[label[moved]], ids[moved]


def agreeing(ids: np.ndarray, sketches: list[bytes], agree: int = AGREE) -> tuple[np.ndarray, np.ndarray]:
    """Star links of the clusters that pairs with ``agree`` or more equal minima make, breadth first."""
    rest = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(ids), -1)
    at, a, b = np.arange(len(ids)), [], []
    while len(at) > 1:
        root, front, at, rest = at[0], [rest[0]], at[1:], rest[1:]
        while front and len(at):
            hit = np.count_nonzero(rest == front.pop(), axis=1) >= agree
            if hit.any():
                a.append(np.full(int(hit.sum()), ids[root]))
                b.append(ids[at[hit]])
                front.extend(rest[hit])
                at, rest = at[~hit], rest[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def links_in_blocks(rows: DataFrame, by: str, carried: str, block: int, linked) -> DataFrame:
    """Links (a, b) that ``linked(ids, values)`` finds among the rows (by, key, carried, rows_of) with equal ``by``.

    Groups of over ``block`` rows are cut into blocks; each pair of blocks goes to a task of its own and also
    covers the pairs within them.
    """
    rows = rows.withColumn("__k", F.ceil(F.col("rows_of") / block).cast("int")).withColumn("__c", F.pmod(F.xxhash64("key"), F.col("__k")).cast("int"))
    pairs = F.expr("if(__k = 1, array(struct(0 as x, 0 as y)), transform(filter(sequence(0, __k - 1), b -> b <> __c), b -> struct(least(b, __c) as x, greatest(b, __c) as y)))")
    rows = rows.select(by, F.explode(pairs).alias("p"), "key", carried).select(by, "p.x", "p.y", "key", carried)
    dealt = rows.repartition(by, "x", "y").sortWithinPartitions(by, "x", "y")

    def run(batches):
        import pyarrow as pa

        flat = (r for b in batches for r in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True))
        for _, group in itertools.groupby(flat, key=lambda r: r[:3]):
            _, _, _, ids, values = zip(*group, strict=True)
            a, b = linked(np.array(ids, np.int64), values)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        give_back()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def exact_links(texts: DataFrame, shingle: int, least: float, block: int) -> DataFrame:
    """Links (a, b) of similar texts from rows (root, key, raw) of candidate groups."""
    rows = texts.join(texts.groupBy("root").agg(F.count("*").alias("rows_of")), "root")
    return links_in_blocks(rows, "root", "raw", block, lambda ids, raw: block_links(ids, [shingle_set(r, shingle) for r in raw], least))


def key_links(firsts: DataFrame, block: int = SKETCHES) -> DataFrame:
    """Links (a, b) between sets that share a band key and whose sketches agree, from rows (key, bands, sketch)."""
    keyed = firsts.select("key", F.explode("bands").alias("val"))
    shared = keyed.groupBy("val").agg(F.count("*").alias("rows_of")).filter("rows_of > 1")
    rows = join_keyed(keyed, shared, ["val"], BANDS * firsts.count())
    return links_in_blocks(rows.join(firsts.select("key", "sketch"), "key"), "val", "sketch", block, agreeing)


def candidates(firsts: DataFrame) -> DataFrame:
    """Candidate groups (node, root) of the sets in rows (key, bands, sketch, fp)."""
    return connected_components(key_links(firsts).union(print_links(firsts.select("key", "fp"))))


def dedup(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """Keep one row of each group: the one with the smallest doc_id (null last), then the smallest text hash."""
    raw, key, bands, made, fp, row = (free_name(docs, c) for c in ("__bytes", "__set", "__bands", "__sketch", "__fp", "__row"))
    numbered = add_keys(docs.withColumn(raw, text_bytes(text)), raw, key, bands, made, fp, shingle).drop(raw).withColumn(row, F.monotonically_increasing_id())
    numbered = materialize(numbered, "numbered")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64(text), F.col(row).alias("row"))
    # equal sets have equal keys, sketches and fingerprints
    same = [F.first(F.col(c)).alias(a) for c, a in ((bands, "bands"), (made, "sketch"), (fp, "fp"))]
    firsts = materialize(numbered.groupBy(F.col(key).alias("key")).agg(F.min(order).alias("o"), *same), "firsts")
    groups = candidates(firsts)
    chosen = firsts.join(groups.withColumnRenamed("node", "key"), "key").select("root", "key", F.col("o.row").alias(row))
    texts = materialize(numbered.select(row, text_bytes(text).alias("raw")).join(chosen, row).select("root", "key", "raw"), "candidates")
    roots = connected_components(exact_links(texts, shingle, least, block))
    rooted = firsts.select("key", "o").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    keep = rooted.groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.row").alias(row))
    return numbered.join(keep, row, "left_semi").select(*docs.columns)
