"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), which takes
time in proportion to the features present. Features: words (each hashed into ``BUCKETS`` minus the
structure slots, x = count / euclidean norm), and bins of structure statistics (share of symbols,
capitals, digits, repeated lines, repeated words, non-ASCII bytes; mean word and line length) and of
metadata (length in bytes, in words, in lines), one slot per statistic and bin, x = 1.

Learning takes at most ``MAX_LABELLED`` labelled rows, a documented bound of the method; features of
these rows are made on the executors and only their sparse vectors come to the driver. The model has
a fixed size (``BUCKETS`` x (``RANK`` + 1) floats). Scoring is one scan without a shuffle.

A null text counts as empty and still gets a score; null or repeated doc_ids each keep their row; an
empty table gives an empty result; without usable labels every score is 0.5. Extra columns pass
through ``score_documents``, those named like its own are replaced.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, give_back, held_out, labelled_sample, map_rows, read_table

BUCKETS, RANK, BINS, MAX_LABELLED = 1 << 16, 8, 12, 8000
STATS = 11
#: Bytes of text that are scored at a time; features and their products take about 50 times that.
SCORE_BYTES = 2 << 20
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.08, 1e-5
#: Upper ends of the bins of shares.
SHARE_EDGES = np.array([0.0, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8])
SYMBOLS = b"#*$%&|<>{}[]=+_~^\\@!"
UPPER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
HIGH = bytes(range(128, 256))


def statistics(b: bytes, words: list[bytes]) -> list[int]:
    """The bin of each statistic of a text."""
    n, w = max(1, len(b)), max(1, len(words))
    lines = [x for x in b.split(b"\n") if x.strip()]
    count = lambda chars: len(b) - len(b.translate(None, chars))
    shares = (
        count(SYMBOLS) / n,
        count(UPPER) / n,
        count(DIGITS) / n,
        count(HIGH) / n,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        1 - len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1) if len(words) > 1 else 0.0,
    )
    logs = (n / w, n / max(1, len(lines)) / 8, n / 16, w / 4, len(lines) + 1)
    return [int(k) for k in np.searchsorted(SHARE_EDGES, shares)] + [min(BINS - 1, int(x).bit_length()) for x in logs]


def features(texts: list[bytes], memo: Memo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a list of texts: row numbers, slots and values, by row."""
    base = BUCKETS - STATS * BINS
    ids, lengths, slots = [], [], []
    for b in texts:
        words = b.split()
        ids += map(memo.__getitem__, words)
        lengths.append(len(words))
        slots.append([base + k * BINS + v for k, v in enumerate(statistics(b, words))])
    rows = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    key, count = np.unique(rows * BUCKETS + np.array(ids, dtype=np.int64), return_counts=True)
    row, slot = key // BUCKETS, key % BUCKETS
    norm = np.sqrt(np.bincount(row, count.astype(float) ** 2, minlength=len(texts)))
    value = count / np.maximum(norm, 1e-9)[row]
    extra = np.array(slots, dtype=np.int64).reshape(-1)
    row = np.concatenate([row, np.repeat(np.arange(len(texts)), STATS)])
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate([slot, extra])[order], np.concatenate([value, np.ones(len(extra))])[order]


def word_bucket(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w.lower(), 7) % (BUCKETS - STATS * BINS)


def forward(model: dict, row: np.ndarray, slot: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores before the sigmoid by the sum-of-squares identity, with the sums that the gradient needs. Every row has a feature."""
    starts = np.searchsorted(row, np.arange(n))
    vx = model["v"][slot] * x[:, None]
    s = np.add.reduceat(vx, starts)
    z = model["b"] + np.add.reduceat(model["w"][slot] * x, starts) + 0.5 * (s * s - np.add.reduceat(vx * vx, starts)).sum(axis=1)
    return z, s, vx


def fit(row: np.ndarray, slot: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict:
    """AdaGrad on the logistic loss over mini-batches in a fixed random order."""
    rng = np.random.default_rng(11)
    model = {"b": 0.0, "w": np.zeros(BUCKETS), "v": rng.normal(0, 0.02, (BUCKETS, RANK))}
    if not len(y):
        return model
    gw, gv, gb = np.full(BUCKETS, 1e-6), np.full((BUCKETS, RANK), 1e-6), 1e-6
    starts = np.append(np.searchsorted(row, np.arange(len(y))), len(row))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            where = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in pick])
            r = np.repeat(np.arange(len(pick)), starts[pick + 1] - starts[pick])
            sl, xs = slot[where], x[where]
            z, s, vx = forward(model, r, sl, xs, len(pick))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            used, inv = np.unique(sl, return_inverse=True)
            dw = np.bincount(inv, g[r] * xs, minlength=len(used)) + DECAY * model["w"][used]
            each = (g[r] * xs)[:, None] * (s[r] - vx)
            dv = np.stack([np.bincount(inv, each[:, f], minlength=len(used)) for f in range(RANK)], axis=1) + DECAY * model["v"][used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += g.sum() ** 2
            model["w"][used] -= RATE * dw / np.sqrt(gw[used])
            model["v"][used] -= 0.3 * RATE * dv / np.sqrt(gv[used])
            model["b"] -= RATE * g.sum() / np.sqrt(gb)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> dict:
    """Learn from at most ``most`` rows of ``labels`` that are not held out."""
    sample = labelled_sample(docs, labels, label, most).withColumn("text", F.col("text").cast("binary"))

    def vectors(texts: list[bytes]) -> dict[str, list]:
        row, slot, x = features(texts, Memo(word_bucket))
        ends = np.searchsorted(row, np.arange(len(texts) + 1))
        return {"slots": [slot[a:b].astype("int32") for a, b in zip(ends, ends[1:], strict=False)], "xs": [x[a:b].astype("float32") for a, b in zip(ends, ends[1:], strict=False)]}

    got = map_rows(sample, ["text"], vectors, {"slots": "array<int>", "xs": "array<float>"}, keep=["doc_id", "y"]).toArrow().sort_by("doc_id")
    sizes = [len(v) for v in got["slots"]]
    flat = lambda c, kind: np.concatenate([v.values.to_numpy(zero_copy_only=False) for v in got[c]] or [np.zeros(0)]).astype(kind)
    model = fit(np.repeat(np.arange(len(sizes)), sizes), flat("slots", np.int64), flat("xs", float), got["y"].to_numpy())
    return {"b": float(model["b"]), "w": model["w"].astype(np.float32), "v": model["v"].astype(np.float32)}


def score_documents(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1 to each row."""

    memo_of = {}

    def run(texts: list[bytes | str | None]) -> dict[str, list]:
        memo = memo_of.setdefault(0, Memo(word_bucket))
        raw = [t.encode() if isinstance(t, str) else t or b"" for t in texts]
        row, slot, x = features(raw, memo)
        z = forward(model, row, slot, x.astype(np.float32), len(raw))[0]
        del row, slot, x, raw
        give_back()
        return {out: 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))}

    return map_rows(docs, [text], run, {out: "double"}, most=SCORE_BYTES)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
