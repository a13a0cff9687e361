"""Language identification by a byte convolutional network.

A text is cut into windows of ``WINDOW`` bytes, which overlap by the widest filter less one, so that every run of
bytes that a filter can see lies in a window; a window passes an embedding of bytes, filters of the widths
``WIDTHS``, a rectifier, the maximum over its positions, and a softmax over languages. A document's
probabilities are the means over its windows, weighted by the bytes that they add. Whole texts are
read, a fixed number of windows at a time, so memory doesn't grow with a text's length.

The embedding and a filter's weights at an offset are multiplied once into a table of 256 rows, so a
filter bank over a window is one table lookup for each offset, added up. Learning is in numpy on the driver,
with Adam on the logistic loss, from windows that the executors cut: ``MAX_LABELLED`` documents, the same
number of each of the ``MAX_LANGUAGES`` most frequent languages (both are documented bounds), chosen by a
hash of their text, and ``PER_TEXT`` windows of each, at places drawn from that hash over the whole text.
Scoring is one scan without a shuffle.

Edge cases: a null text, an empty one or one without a letter gives ``und`` with score 0; so does every
text when no label can be learnt from; documents with a null lang are not learnt from, but scored; null and repeated
doc_ids keep their rows (a null doc_id counts as not held out); ties go to the language first in order;
an empty table gives an empty result; extra columns pass through ``identify``, those named like its own are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, map_rows, read_table, text_bytes

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4, 5), 12, 8
STRIDE = WINDOW - max(WIDTHS) + 1
MAX_LABELLED, MAX_LANGUAGES, PER_TEXT = 6000, 200, 2
EPOCHS, BATCH, RATE = 6, 32, 0.004
#: Windows that are scored at a time.
CHUNK = 16
LETTER = r"\p{L}"


def is_held_out() -> Column:
    """Rows that are never learnt from: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Network:
    """Byte embedding, filters by width, and the last layer; all arrays of a fixed size."""

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "_buffers"}

    def __init__(self, languages: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        n = FILTERS * len(WIDTHS)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, 0.3, (max(WIDTHS), EMBED, n)).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)
        width = np.repeat(WIDTHS, FILTERS)
        self.used = (np.arange(max(WIDTHS))[:, None] < width[None]).astype(np.float32)  # offsets that a filter has

    def parameters(self) -> list[str]:
        return ["embed", "filters", "bias", "out", "out_bias"]

    def tables(self) -> np.ndarray:
        """(offset, byte, filter): what a byte adds to a filter at an offset."""
        return np.einsum("be,kef->kbf", self.embed, self.filters * self.used[:, None])

    def pooled(self, windows: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest value of each filter in each window, before the rectifier, and where it is."""
        n = STRIDE
        x = np.take(tables[0], windows[:, :n], axis=0)
        for k in range(1, len(tables)):
            x += np.take(tables[k], windows[:, k : k + n], axis=0)
        at = x.argmax(1)
        return np.take_along_axis(x, at[:, None], 1)[:, 0] + self.bias, at

    def largest(self, windows: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """As pooled(), without the places, in arrays that are used again."""
        x, y = (b[: len(windows)] for b in self.buffers())
        windows = windows.astype(np.intp)
        np.take(tables[0], windows[:, :STRIDE], axis=0, out=x, mode="clip")  # clip: else numpy copies the output once more
        for k in range(1, len(tables)):
            np.take(tables[k], windows[:, k : k + STRIDE], axis=0, out=y, mode="clip")
            x += y
        return x.max(1) + self.bias

    def buffers(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_buffers"):
            self._buffers = tuple(np.empty((CHUNK, STRIDE, len(self.bias)), np.float32) for _ in range(2))
        return self._buffers

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.out + self.out_bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def gradients(self, windows: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss; the maximum passes its gradient to the place where it is."""
        m = len(y)
        top, at = self.pooled(windows, self.tables())
        hidden = np.maximum(top, 0)
        dz = self.probabilities(top)
        dz[np.arange(m), y] -= 1
        dz /= m
        back = (dz @ self.out.T) * (top > 0)
        g_embed, g_filters = np.zeros_like(self.embed), np.zeros_like(self.filters)
        cols = np.arange(top.shape[1])
        for k in range(max(WIDTHS)):
            seen = np.take_along_axis(windows, at + k, 1)  # the byte that each filter's maximum has at this offset
            dt = np.zeros((256, len(cols)), np.float32)
            np.add.at(dt, (seen, np.broadcast_to(cols, seen.shape)), back)
            w = self.filters[k] * self.used[k]
            g_embed += dt @ w.T
            g_filters[k] = (self.embed.T @ dt) * self.used[k]
        return [g_embed, g_filters, back.sum(0), hidden.T @ dz, dz.sum(0)]


def fit(windows: np.ndarray, y: np.ndarray, languages: list[str]) -> Network:
    """Adam over mini-batches in a fixed random order."""
    net, rng = Network(languages), np.random.default_rng(7)
    names = net.parameters()
    first = {p: np.zeros_like(getattr(net, p)) for p in names}
    second = {p: np.zeros_like(getattr(net, p)) for p in names}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            step += 1
            for p, g in zip(names, net.gradients(windows[pick], y[pick]), strict=True):
                first[p] = 0.9 * first[p] + 0.1 * g
                second[p] = 0.999 * second[p] + 0.001 * g * g
                move = (first[p] / (1 - 0.9**step)) / (np.sqrt(second[p] / (1 - 0.999**step)) + 1e-8)
                setattr(net, p, (getattr(net, p) - RATE * move).astype(np.float32))
    return net


def padded(pieces: list[bytes]) -> np.ndarray:
    """Windows as rows of WINDOW bytes, filled up with zero bytes."""
    return np.frombuffer(b"".join(p.ljust(WINDOW, b"\0") for p in pieces), np.uint8).reshape(-1, WINDOW)


def starts(n: int) -> range:
    """Where the windows of a text of n bytes start; a further one only if the earlier leave a byte unread."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def train(docs: DataFrame, most: int = MAX_LABELLED) -> Network | None:
    """Learn from (text, lang) of rows that are not held out; None if there are none with a letter."""
    text = text_bytes()
    usable = docs.filter(~is_held_out() & F.col("lang").isNotNull() & F.col("text").cast("string").rlike(LETTER)).select(F.col("lang").cast("string").alias("lang"), text.alias("b"))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return None
    share = max(1, most // len(counts))
    # each language is thinned by the hash first, so that few rows beyond the bound are sorted
    rate = {r["lang"]: min(1.0, 1.5 * share / r["count"] + 50 / r["count"]) for r in counts}
    rates = F.create_map(*[F.lit(x) for kv in rate.items() for x in kv])
    h = F.xxhash64("b")
    at = lambda j: (F.pmod(F.xxhash64(h, F.lit(j)), F.greatest(F.octet_length("b") - WINDOW + 1, F.lit(1)).cast("long")) + 1).cast("int")
    kept = usable.filter(F.pmod(h, F.lit(1 << 20)) < F.element_at(rates, F.col("lang")) * (1 << 20))
    kept = kept.select("lang", h.alias("h"), F.array(*[F.substring("b", at(j), WINDOW) for j in range(PER_TEXT)]).alias("w"))
    ranked = kept.selectExpr("lang", "w", "h", "row_number() OVER (PARTITION BY lang ORDER BY h, w) AS k").filter(F.col("k") <= share)
    got = ranked.toArrow().sort_by([("lang", "ascending"), ("k", "ascending")])
    languages = sorted(set(got["lang"].to_pylist()))
    number = {x: i for i, x in enumerate(languages)}
    pieces = [bytes(p) for w in got["w"].to_pylist() for p in w]
    y = np.repeat([number[x] for x in got["lang"].to_pylist()], PER_TEXT)
    return fit(padded(pieces), y, languages)


def probabilities_of(texts: list[bytes], net: Network, tables: np.ndarray) -> np.ndarray:
    """Mean probabilities over the windows of each text; CHUNK windows are in work at a time."""
    total, weight = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    owner: list[int] = []
    pieces: list[bytes] = []

    def flush() -> None:
        p = net.probabilities(net.largest(padded(pieces), tables))
        w = np.array([max(1, len(x)) for x in pieces], float)
        np.add.at(total, owner, p * w[:, None])
        np.add.at(weight, owner, w)
        owner.clear()
        pieces.clear()

    for k, t in enumerate(texts):
        for a in starts(len(t)):
            owner.append(k)
            pieces.append(t[a : a + WINDOW])
            if len(pieces) == CHUNK:
                flush()
    if pieces:
        flush()
    return total / np.maximum(weight, 1)[:, None]


def identify(docs: DataFrame, net: Network | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its probability to each row."""
    if net is None:
        return docs.withColumns({pred: F.lit("und"), score: F.lit(0.0)})
    tables = net.tables()

    def run(texts: list[str | None], letters: list[bool]) -> dict[str, list]:
        rows = [k for k, yes in enumerate(letters) if yes]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        raw = [t if isinstance(t := texts[k], bytes) else t.encode() for k in rows]
        for k, p in zip(rows, probabilities_of(raw, net, tables), strict=True):
            best = int(p.argmax())
            names[k], scores[k] = net.languages[best], min(1.0, float(p[best]))
        return {pred: names, score: scores}

    flag = free_name(docs, "__letter")
    marked = docs.withColumn(flag, F.coalesce(F.col(text).cast("string").rlike(LETTER), F.lit(False)))
    return map_rows(marked, [text, flag], run, {pred: "string", score: "double"}, keep=docs.columns)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(docs)
    return identify(docs.select("doc_id", "text"), net).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
