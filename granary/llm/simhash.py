"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprint: A-Z are lower-cased, words are runs without ASCII white space, and each run of four
words (joined by blanks; of fewer words the whole sequence) is hashed by XXH64 with seed 42. A bit of
the fingerprint is set if more than half of the hashes have it set. A text without words has
fingerprint zero and is linked like any other.

Links (``most`` or fewer differing bits) between distinct fingerprints:

1. From a bounded sample (``SAMPLE`` fingerprints) the correlation of bits is estimated and bits that
   go together are grouped into m partitions, for several m.
2. For each partition and threshold t the number of candidate pairs (as in the sample, scaled to all)
   and of probes gives a cost. Dynamic programming allots thresholds t_i >= -1 with
   sum(t_i + 1) = most + 1 at the least cost; -1 leaves a partition out. By the pigeonhole principle
   two fingerprints within ``most`` bits are within t_i bits in some partition i. The cheapest m wins.
   The sample only steers the cost: links are complete for any allotment.
3. Every fingerprint is indexed by its bits in each partition in use, and probes the neighbouring
   values within t_i; of two values only one side probes. What shares a key is compared exactly.
4. Keys with more than ``BLOCK`` rows are split into blocks, and blocks are compared pairwise in
   different tasks, so no task holds an unbounded group. From a block come star links (each member
   to the first of its cluster), never all pairs.

Copies share a fingerprint and are handled once. Components are found without collecting links.

Null texts count as empty. A null doc_id keeps its row and never becomes a component's id unless all
ids in the component are null. Repeated rows each get their row. Empty tables give empty results.
``dedup`` keeps whole rows, extra columns included; of rows tied for the smallest doc_id one stays.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, map_rows, materialize, read_table, text_bytes
from .components import connected_components

BITS, MOST, SHINGLE, SEED = 64, 4, 4, 42
SAMPLE, BLOCK = 20_000, 512
#: Estimates of pairs: bit flips tried on the sample, and rows of the sample compared in pairs beyond them.
FLIPS, PAIRED = 300, 2_000
#: Microseconds that a row dealt out by key and a compared pair take.
ROW_COST, PAIR_COST = 4.0, 0.015
#: Hot keys are broadcast up to this number, else joined.
MOST_HOT = 20_000


def fingerprint(b: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a text in UTF-8."""
    words = b.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    total, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):
        h = np.array([digest(line[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view(np.uint64)[0])


def add_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed 64-bit number."""
    run = lambda texts: {out: np.array([fingerprint(t.encode() if isinstance(t, str) else t or b"") for t in texts], np.uint64).view(np.int64)}
    return map_rows(docs, [text], run, {out: "long"})


# --- the plan: bits to partitions, thresholds by dynamic programming


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of about equal size; each grows by the bit that correlates most with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32) if len(sample) else np.zeros((1, BITS), np.float32)
    z = bits - bits.mean(axis=0)
    sd = np.sqrt((z * z).mean(axis=0))
    corr = np.abs(z.T @ z / len(z)) / np.maximum(np.outer(sd, sd), 1e-6)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        seed = max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            b = max(sorted(free), key=lambda b: corr[b, group].mean())
            group.append(b)
            free.remove(b)
        groups.append(sorted(group))
    return groups


def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def sample_pairs(sample: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Pairs of the sample that differ in t bits or fewer of a partition, for t = 0 to most.

    Deep thresholds, where flipping bits costs more than comparing, are estimated on all pairs of the first ``PAIRED`` rows.
    """
    masked = sample & np.uint64(mask_of(bits))
    values, counts = np.unique(masked, return_counts=True)
    out = [float((counts * (counts - 1.0) / 2).sum())]
    for t in range(1, most + 1):
        if math.comb(len(bits), t) > FLIPS:
            some = masked[:PAIRED]
            apart = np.bincount(np.bitwise_count(some[:, None] ^ some[None, :]).ravel(), minlength=BITS + 1)
            apart[0] -= len(some)
            within = np.cumsum(apart) / 2 * (len(sample) / len(some)) ** 2
            return out + [max(out[-1], float(w)) for w in within[t : most + 1]]
        more = 0.0
        for flip in itertools.combinations(bits, t):
            other = values ^ np.uint64(mask_of(flip))
            at = np.minimum(np.searchsorted(values, other), len(values) - 1)
            more += float((counts * np.where(values[at] == other, counts[at], 0)).sum()) / 2
        out.append(out[-1] + more)
    return out


def allot(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds t_i (from -1) of least total cost with sum(t_i + 1) = budget; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for k, x in enumerate(row):
                if used + k <= budget and (used + k not in after or c + x < after[used + k][0]):
                    after[used + k] = (c + x, [*ts, k - 1])
        best = after
    return best.get(budget, (math.inf, []))


def plan(sample: np.ndarray, n: int, most: int = MOST) -> list[tuple[list[int], int]]:
    """Partitions in use (bits, threshold) of least estimated cost for n distinct fingerprints."""
    scale, found = (n / max(1, len(sample))) ** 2, []
    for m in range(2, most + 3):
        groups, costs = group_bits(sample, m), []
        for bits in groups:
            deepest = min(most, len(bits))
            pairs = sample_pairs(sample, bits, deepest) if len(sample) else [0.0] * (deepest + 1)
            probes = [sum(math.comb(len(bits), j) for j in range(1, t + 1)) / 2 + 1 for t in range(deepest + 1)]
            costs.append([0.0] + [n * ROW_COST * probes[t] + pairs[t] * scale * PAIR_COST for t in range(deepest + 1)])
        cost, ts = allot(costs, most + 1)
        if ts:
            found.append((cost, m, [(b, t) for b, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(found, key=lambda x: (x[0], x[1]))[2]


# --- probe and verify


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def index_and_probe(prints: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """Rows (part, val, fp, own): each fingerprint under its own value of each partition, and under those it probes.

    Of two values that differ in some bits, the one with a 0 in the lowest of these bits probes.
    """
    rows = []
    for k, (bits, t) in enumerate(parts):
        base = f"(fp & {signed(mask_of(bits))}L)"
        rows.append(f"array(struct({k} as part, {base} as val, true as own))")
        for j in range(1, t + 1):
            flips = ", ".join(f"struct({signed(mask_of(c))}L as f, {signed(1 << c[0])}L as low)" for c in itertools.combinations(bits, j))
            rows.append(f"transform(filter(array({flips}), x -> (fp & x.low) = 0), x -> struct({k} as part, {base} ^ x.f as val, false as own))")
    return prints.select("fp", F.expr(f"explode(concat({', '.join(rows)})) as r")).select("r.part", "r.val", "fp", "r.own")


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Add (x, y): what is to be compared has the same part, val, x and y. Keys of up to ``block`` rows are one block."""
    counts = rows.groupBy("part", "val").agg(F.count_if("own").alias("owned"), F.count_if(~F.col("own")).alias("probed"))
    hot = materialize(counts.filter(F.col("owned") + F.col("probed") > block), "hot-keys")
    few = hot.limit(MOST_HOT + 1).count() <= MOST_HOT
    out = rows.join(F.broadcast(hot) if few else hot, ["part", "val"], "left")
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    at = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    blocks = F.expr("""case when owned is null then array(struct(0 as x, 0 as y))
        when owned = 0 then array()
        when own then concat(transform(sequence(0, ko - 1), b -> struct(least(b, chunk) as x, greatest(b, chunk) as y)), if(kp > 0, transform(sequence(0, kp - 1), p -> struct(chunk as x, -1 - p as y)), array()))
        else transform(sequence(0, ko - 1), a -> struct(a as x, -1 - chunk as y)) end""")
    out = out.withColumns({"ko": parts("owned"), "kp": parts("probed")}).withColumn("chunk", F.when(F.col("own"), at(F.greatest("ko", F.lit(1)))).otherwise(at(F.greatest("kp", F.lit(1)))))
    return out.select("part", "val", "fp", "own", F.explode(blocks).alias("b")).select("part", "val", "b.x", "b.y", "fp", "own")


def near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


def compare_block(fp: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links of the clusters that links between an own row and any row make."""
    o = np.flatnonzero(own)
    if not len(o):
        return fp[:0], fp[:0]
    m = near(fp[o][:, None], fp[None, :], most)
    label = np.arange(len(fp))
    while True:
        low = np.where(m, label[None, :], len(fp)).min(axis=1)
        new = label.copy()
        new[o] = np.minimum(new[o], low)
        new = np.minimum(new, np.where(m, new[o][:, None], len(fp)).min(axis=0))
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(fp))
    return fp[label[moved]], fp[moved]


def compare_runs(run: np.ndarray, fp: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal numbers; short runs all at once by shifting, long ones as blocks."""
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    size = np.diff(np.r_[first, len(run)])
    left, right = [], []
    for a, n in zip(first[size > 48].tolist(), size[size > 48].tolist(), strict=True):
        x, y = compare_block(fp[a : a + n], own[a : a + n], most)
        left.append(x)
        right.append(y)
    rest = np.repeat((size <= 48) & (size > 1), size)
    run, fp, own = run[rest], fp[rest], own[rest]
    for d in range(1, 48):
        if len(run) <= d:
            break
        same = (run[:-d] == run[d:]) & (own[:-d] | own[d:])
        if not (run[:-d] == run[d:]).any():
            break
        hit = np.flatnonzero(same)
        hit = hit[near(fp[hit], fp[hit + d], most)]
        left.append(fp[hit])
        right.append(fp[hit + d])
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def link(prints: DataFrame, most: int = MOST, block: int = BLOCK, parts=None) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``prints`` (distinct fp) within ``most`` bits."""
    if parts is None:
        sample = np.array([r.fp for r in prints.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
        parts = plan(sample, prints.count(), most)
    keys = ["part", "val", "x", "y"]
    dealt = in_blocks(index_and_probe(prints, parts), block)
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        import pyarrow as pa

        held = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
                cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            elif held is None:
                return
            else:
                cols = held
            n = len(cols[0])
            change = np.zeros(max(0, n - 1), bool)
            for c in cols[:4]:
                change |= c[1:] != c[:-1]
            numbers = np.r_[0, np.cumsum(change)] if n else np.zeros(0, int)
            cut = n if b is None else int(np.searchsorted(numbers, numbers[-1])) if n else 0  # the last run may go on in the next batch
            held = [c[cut:] for c in cols]
            if cut:
                x, y = compare_runs(numbers[:cut], cols[4][:cut].view(np.uint64), cols[5][:cut].astype(bool), most)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])
            if b is None:
                return

    return dealt.mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", most: int = MOST) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs, from doc_id and the text alone."""
    prints = materialize(add_fingerprint(docs.select("doc_id", text_bytes(text).alias("__b")), "__b").select("doc_id", "fp"), "fingerprints")
    return prints.join(classes(prints, most), "fp").select("doc_id", "fp", "component_id")


def classes(prints: DataFrame, most: int = MOST) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of (doc_id, fp)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-prints")
    roots = connected_components(link(distinct.select("fp"), most))
    rooted = materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    # components with one fingerprint need no second look-up; a row for each root is made before the shuffle
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def dedup(docs: DataFrame, text: str = "text", most: int = MOST) -> DataFrame:
    """Keep one row of each group: the one with the smallest doc_id (null last), then the smallest text hash."""
    raw, fp, row = (free_name(docs, c) for c in ("__bytes", "__fp", "__row"))
    numbered = add_fingerprint(docs.withColumn(raw, text_bytes(text)), raw, fp).drop(raw).withColumn(row, F.monotonically_increasing_id())
    numbered = materialize(numbered, "numbered")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64(text), F.col(row).alias("row"))
    firsts = materialize(numbered.select(F.col(fp).alias("fp"), order.alias("o")).groupBy("fp").agg(F.min("o").alias("o")), "firsts")
    roots = connected_components(link(firsts.select("fp"), most))
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    keep = rooted.groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.row").alias(row))
    return numbered.join(keep, row, "left_semi").select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
