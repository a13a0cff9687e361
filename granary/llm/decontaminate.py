"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items become words (lower case, ASCII punctuation as blanks) and distances count edited
words. A document leaks an item of L words if some run of its words is within ``max_edits(L)`` edits
(a fifth of L) of the item.

1. Where to look: an item within k edits keeps one of its k + 1 pieces whole, so a run of q words of
   the item (q = L // (k + 1), at most 4) must stand in the document. Each such run, at its offset in
   the item, gives item-sized windows shifted by up to k words. This loses nothing.
2. Each window is embedded ``REPEATS`` times by the CGK random walk (output j is the current word;
   the walk goes on to the next word if a random bit of (word, j) says so), which turns edits into
   few differing outputs. ``SAMPLED`` outputs of each embedding make a key; a window is a candidate
   for an item of its size if any key is equal. Repeats make up for the samples that edits hit.
3. Candidates are verified by the exact edit distance of the item to any run of words around the
   window (bit-parallel dynamic programming).

Items are broadcast in blocks of at most ``BLOCK_BYTES`` of text, each block against all documents;
documents never move, so there is no shuffle and no skew.

Null texts and items have no words and match nothing; an item of fewer than five words must occur
exactly. Repeated rows each get their row. Empty tables give empty results. Extra columns of the
documents pass through; those named like a new column are replaced.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, map_rows, read_table
from .wordhash import GOLD, Hasher, U, groups, mix

SHARE, REPEATS, SAMPLED, STRETCH = 0.2, 12, 2, 3
BLOCK_BYTES = 8 << 20
BLANKED = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
SLOTS = 1 << 20


def max_edits(n: int) -> int:
    return int(SHARE * n + 1e-9)


def plain(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace").translate(BLANKED)


def edit_search(item: list[int], text: list[int]) -> tuple[int, int]:
    """(least edit distance of the item to a run of the text, end of the first such run), by bit-parallel dynamic programming."""
    m = len(item)
    masks: dict[int, int] = {}
    for k, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, d = full, 0, m
    best, at = m, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        x = eq | minus
        diag = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(diag | plus) & full
        down = plus & diag
        if up & top:
            d += 1
        elif down & top:
            d -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | ~(x | up) & full
        minus = up & x
        if d < best:
            best, at = d, j + 1
    return best, at


class Items:
    """A block of benchmark items: their words, runs of words and keys."""

    def __init__(self, ids: list, texts: list[str | None], repeats: int = REPEATS, sampled: int = SAMPLED, seed: int = 5):
        self.hasher = Hasher()
        h, of, *_ = self.hasher.words([plain(t) for t in texts])
        n = np.bincount(of, minlength=len(texts)) if len(texts) else np.zeros(0, int)
        base = np.r_[0, np.cumsum(n)]
        use = [k for k in range(len(texts)) if n[k]]
        self.ids = [ids[k] for k in use]
        self.words = [h[base[k] : base[k + 1]] for k in use]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.k = np.array([max_edits(x) for x in self.n], np.int64)
        self.q = np.minimum(4, self.n // (self.k + 1))
        rng = np.random.default_rng(seed)
        longest = int(self.n.max()) if len(self.n) else 1
        self.repeats, self.sampled = repeats, sampled
        self.salt = rng.integers(0, 1 << 63, (repeats, STRETCH * longest // 64 + 1), dtype=np.uint64)
        self.places = {}  # outputs sampled, by size of item: (repeats, sampled), rising
        for size in sorted(set(self.n.tolist())):
            self.places[size] = np.sort(np.array([rng.permutation(STRETCH * size)[:sampled] for _ in range(repeats)]), axis=1)
        self.grams = {}
        for q in sorted(set(self.q.tolist())):
            key, item, offset = [], [], []
            for k in np.flatnonzero(self.q == q):
                at = np.arange(self.n[k] - q + 1)
                key.append(self.hasher.spans(self.words[k], at, at + q))
                item.append(np.full(len(at), k))
                offset.append(at)
            key, item, offset = np.concatenate(key), np.concatenate(item), np.concatenate(offset)
            order = np.argsort(key, kind="stable")
            seen = np.zeros(SLOTS, bool)
            seen[key & U(SLOTS - 1)] = True
            self.grams[q] = key[order], item[order], offset[order], seen
        if len(self.n):
            flat = np.concatenate(self.words)
            starts = np.r_[0, np.cumsum(self.n)][:-1]
            keys = self.keys(flat, starts, starts + self.n, self.n)
            order = np.argsort(keys.ravel(), kind="stable")
            self.key_of, self.item_of = keys.ravel()[order], np.repeat(np.arange(len(self.n)), repeats)[order]

    def keys(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(windows, repeats) keys of the windows [start, end) of h, embedded as for items of the given sizes."""
        count, r = len(start), self.repeats
        at = np.repeat(start, r)
        stop = np.repeat(end, r)
        rep = np.tile(np.arange(r), count)
        places = np.stack([self.places[s] for s in size.tolist()]).reshape(count * r, self.sampled) if count else np.zeros((0, self.sampled), int)
        key = mix(np.repeat(size.astype(np.uint64), r) * GOLD + rep.astype(np.uint64))
        h = np.r_[h, U(0)]
        for j in range(int(places.max()) + 1 if count else 0):
            word = np.where(at < stop, h[np.minimum(at, len(h) - 1)], U(0))
            taken = (places == j).any(axis=1)
            key = np.where(taken, mix(key ^ (word + U(j * int(GOLD) % (1 << 64)))), key)
            step = mix(word ^ self.salt[rep, j // 64]) >> U(j % 64) & U(1)
            at = at + step.astype(np.int64)
        return key.reshape(count, r)


def matches(items: Items, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    """For each text (item number, distance, first word of the search region) of the items that it leaks."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    raw = [plain(t) for t in texts]
    for a, e in groups(raw, 1 << 20):
        h, doc, *_ = items.hasher.words(raw[a:e])
        if not len(h) or not len(items.n):
            continue
        bound = np.searchsorted(doc, np.arange(e - a + 1))
        item, start = [], []
        for q, (key, of, offset, seen) in items.grams.items():
            at = np.arange(max(0, len(h) - q + 1))
            g = items.hasher.spans(h, at, at + q)
            hit = np.flatnonzero(seen[g & U(SLOTS - 1)])
            hit = hit[doc[hit] == doc[hit + q - 1]]
            lo, hi = np.searchsorted(key, g[hit], "left"), np.searchsorted(key, g[hit], "right")
            hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item.append(of[k])
            start.append(np.repeat(hit, n) - offset[k] + (np.repeat(doc[hit], n).astype(np.int64) << 40))
        item, start = np.concatenate(item), np.concatenate(start)
        if not len(item):
            continue
        # item-sized windows at the offsets, shifted by up to k words; a window of a size is made once
        pair = np.unique(np.stack([items.n[item], start], axis=1), axis=0)
        edits = np.array([max_edits(x) for x in pair[:, 0].tolist()])
        size = np.repeat(pair[:, 0], 2 * edits + 1)
        shift = np.arange(len(size)) - np.repeat(np.cumsum(2 * edits + 1) - (2 * edits + 1), 2 * edits + 1) - np.repeat(edits, 2 * edits + 1)
        d = np.repeat((pair[:, 1] + (1 << 39)) >> 40, 2 * edits + 1)
        first = np.repeat(pair[:, 1], 2 * edits + 1) - (d << 40) + shift
        first = np.clip(first, bound[d], None)
        window = np.unique(np.stack([size, d, first], axis=1), axis=0)
        window = window[window[:, 2] < bound[window[:, 1] + 1]]
        for w in range(0, len(window), 4096):
            part = window[w : w + 4096]
            stop = np.minimum(part[:, 2] + part[:, 0], bound[part[:, 1] + 1])
            keys = items.keys(h, part[:, 2], stop, part[:, 0]).ravel()
            lo, hi = np.searchsorted(items.key_of, keys, "left"), np.searchsorted(items.key_of, keys, "right")
            n = hi - lo
            k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(np.arange(len(keys)), n) // items.repeats
            for dn, it in np.unique(np.stack([part[row, 1], items.item_of[k]], axis=1), axis=0).tolist():
                at = np.unique(part[row[(part[row, 1] == dn) & (items.item_of[k] == it)], 2])
                verify(items, h, bound, dn, it, at, out[a + dn])
    return [sorted({m[0]: m for m in sorted(ms, key=lambda m: -m[1])}.values()) for ms in out]


def verify(items: Items, h: np.ndarray, bound: np.ndarray, d: int, it: int, starts: np.ndarray, found: list) -> None:
    """Search the item around its candidate windows, neighbouring windows as one region."""
    n, k = int(items.n[it]), int(items.k[it])
    for region in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):
        lo, hi = max(int(bound[d]), int(region[0]) - k), min(int(bound[d + 1]), int(region[-1]) + n + k)
        distance, _ = edit_search(items.words[it].tolist(), h[lo:hi].tolist())
        if distance <= k:
            found.append((it, distance, lo - int(bound[d])))


HIT_TYPE = "array<struct<item_id:bigint,distance:int,word:int>>"


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", out: str = "leaks", repeats: int = REPEATS) -> DataFrame:
    """Add the leaked items (item_id, distance, first word of the region) of each document."""
    sized = items.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    total = sized.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    blocks = -(-max(1, total) // BLOCK_BYTES)
    columns = []
    for k in range(blocks):  # each block of items is at most about BLOCK_BYTES
        got = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect() if blocks > 1 else sized.collect()
        got = sorted({(r.item_id is None, r.item_id or 0, r.text) for r in got})
        ids, texts = [None if g[0] else g[1] for g in got], [g[2] for g in got]
        made: dict[int, Items] = {}

        def run(batch: list[str | None], ids=ids, texts=texts, made=made, name=out if blocks == 1 else f"__leaks{k}") -> dict[str, list]:
            if not made:
                made[0] = Items(ids, texts, repeats)
            block = made[0]
            return {name: [[{"item_id": block.ids[i], "distance": d, "word": w} for i, d, w in ms] for ms in matches(block, batch)]}

        name = out if blocks == 1 else f"__leaks{k}"
        columns.append(name)
        docs = map_rows(docs, [text], run, {name: HIT_TYPE})
    if blocks > 1:
        docs = docs.withColumn(out, F.concat(*columns)).drop(*columns)
    return docs


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that leak no item, with their columns."""
    leaks = free_name(docs, "__leaks")
    return find_leaks(docs, items, text, leaks).filter(F.size(leaks) == 0).select(*docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", "l.distance")
