"""Toxicity: decode obfuscated spelling with a noisy channel, then score the restored text.

1. A character trigram model is counted over the words of every document (each partition sends its
   own counts, which are added up; the sums have a fixed size, ``SYMBOLS`` cubed at most).
2. Each token becomes a lattice: a letter stands for itself or, after an equal one, for nothing
   (repetition); a digit or sign stands for the letters it resembles or for nothing, a digit also for
   itself, a sign for a word end (leetspeak); a dot, dash or the like between letters stands for nothing
   or a word end; single characters set apart by blanks form one lattice with an optional word end in
   each gap (spacing). Viterbi decoding under the character model picks the most probable reading.
   Tokens whose lattice has one path (letters without a run of three) need no decoding; nor do numbers
   (digits alone). A token of signs and digits is decoded if all its characters resemble letters.
3. Restored words, with runs squeezed to one letter, and their prefixes are looked up in a lexicon
   learnt from the labels: features for which the lower confidence limit of the share of toxic
   documents among those that contain it is at least ``LEAST_SHARE``, weighted by a logistic
   regression on their presence. A document's score is that regression's probability, or the lower
   limit of its surest whole word if that is larger.

Learning takes at most ``MAX_LABELLED`` labelled rows (a bound of the method), and every feature of these
that is sure enough; the character counts cover all documents. Null texts count as empty and get
the prior as their score; null or repeated doc_ids and equal texts each keep their row, with equal
scores for equal texts; of readings with equal probability the smaller text counts; empty tables give an empty
result; without usable labels the score is 0.1. Extra columns pass through ``score_documents``.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, held_out, labelled_sample, map_rows, materialize, read_table, release, text_bytes

#: The letters of the character model; 0 is a word end, the last symbol any other character.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøœùúûüýÿß"
SYMBOLS = len(LETTERS) + 2
OTHER = SYMBOLS - 1
#: The letters that a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "#": "h", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k",
}
SEPARATORS = frozenset(".,-_*~'`^:;/\\#%&=·​‌‍­﻿")
EDGE = " .,;:?!\"'()[]{}<>…*&%#~`-_/\\|+=^«»„“”‚‘’–—$@​﻿"
#: Natural logarithms of the channel's probabilities.
SUBSTITUTE, DROP_SIGN, DROP_MARK, DROP_SECOND, DROP_THIRD, KEEP_SIGN, KEEP_DIGIT, SPLIT = -0.3, -9.0, -1.0, -2.0, -0.3, -9.0, -1.5, -1.5
PUNCTUATION = ".,;:?\"'()[]{}<>…"
LOOKALIKE = frozenset(LEET)
WEIGHTS = (0.75, 0.2, 0.05)  # of trigram, bigram and single counts

MAX_LABELLED, CONFIDENCE, LEAST_SHARE = 20_000, 2.0, 0.5
#: A whole word whose lower limit is at least this speaks for itself, however many others usually stand beside it.
ALONE = 0.8
PREFIXES = (4, 5, 6, 7, 8)
RUN = re.compile(r"(.)\1\1")
PAIR = re.compile(r"(.)\1+")
CODE = {c: k + 1 for k, c in enumerate(LETTERS)}


class CharModel:
    """Interpolated trigram log-probabilities over ``SYMBOLS`` symbols."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
        p2 = (c2 + p1) / (c2.sum(axis=1, keepdims=True) + 1)
        p3 = (c3 + p2[None]) / (c3.sum(axis=2, keepdims=True) + 1)
        self.log = np.log(WEIGHTS[0] * p3 + WEIGHTS[1] * p2[None] + WEIGHTS[2] * p1[None, None]).astype(np.float32)

    def table(self) -> list[list[list[float]]]:
        return self.log.tolist()


def count_trigrams(words: Counter) -> np.ndarray:
    """Counts of symbol trigrams in lower-cased words, each with a word end before (twice) and after."""
    if not words:
        return np.zeros(SYMBOLS**3, np.int64)
    text = "\0\0" + "\0\0".join(words) + "\0"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    table = np.full(0x2000, OTHER, np.int64)
    table[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)
    table[0] = 0
    codes = np.where(points < 0x2000, table[np.minimum(points, 0x1FFF)], OTHER)
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    weight = np.fromiter(words.values(), np.int64, len(words))
    first = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]])  # of the two word ends in front of each word
    inside = np.ones(len(codes), bool)
    inside[np.concatenate([first, first + 1, [len(codes) - 1]])] = False
    code = lambda at: (codes[at - 2] * SYMBOLS + codes[at - 1]) * SYMBOLS
    at = np.flatnonzero(inside)
    inner = np.bincount(code(at) + codes[at], np.repeat(weight, lengths), minlength=SYMBOLS**3)
    tail = np.bincount(code(np.append(first[1:], len(codes) - 1)), weight, minlength=SYMBOLS**3)
    return (inner + tail).astype(np.int64)


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts over the words of all rows; what comes to the driver has at most SYMBOLS cubed numbers."""

    def run(batches):
        import pyarrow as pa

        total, words, size = np.zeros(SYMBOLS**3, np.int64), Counter(), 0
        for b in batches:
            for t in b.column(0):
                words.update(t.as_py().decode("utf-8", "replace").lower().split())
                if len(words) > 100_000:
                    total += count_trigrams(words)
                    words = Counter()
        total += count_trigrams(words)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    got = docs.select(text_bytes(text).alias("t")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**3, np.int64)
    counts[got["code"].to_numpy()] = got["n"].to_numpy()
    return counts


def options(chars: str) -> list[list[tuple[str, float]]]:
    """The lattice of a token: per character the strings it may stand for, with log-probabilities. "\\0" is a word end."""
    out, before, run = [], "", 0
    for c in chars:
        run = run + 1 if c == before else 1
        if c == " ":
            out.append([("", 0.0), ("\0", SPLIT)])
        elif c in CODE:
            out.append([(c, 0.0)] + ([("", DROP_SECOND if run == 2 else DROP_THIRD)] if run > 1 else []))
        elif c in LEET:
            marks = [("", DROP_MARK), ("\0", SPLIT)] if c in SEPARATORS else [("", DROP_THIRD if run > 1 else DROP_SIGN)]
            own = (c, KEEP_DIGIT) if c.isdigit() else ("\0", KEEP_SIGN)
            out.append([(x, SUBSTITUTE) for x in LEET[c]] + ([own] if own[0] not in [x for x, _ in marks] else []) + marks)
        elif c in SEPARATORS:
            out.append([("", DROP_MARK), ("\0", SPLIT)])
        else:
            out.append([(c, KEEP_SIGN)])
        before = c
    return out


def viterbi(chars: str, table: list[list[list[float]]]) -> str:
    """The most probable reading of a lattice; of equal ones the smaller text. Words are set apart by a blank."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for opts in options(chars):
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (s, said) in states.items():
            for x, cost in opts:
                if x == "" or (x == "\0" and b == 0):
                    key, new = (a, b), (s + cost, said)
                elif x == "\0":
                    key, new = (0, 0), (s + cost + table[a][b][0], said + " ")
                else:
                    k = CODE.get(x, OTHER)
                    key, new = (b, k), (s + cost + table[a][b][k], said + x)
                old = after.get(key)
                if old is None or new[0] > old[0] or (new[0] == old[0] and new[1] < old[1]):
                    after[key] = new
        states = after
    best = max(((s + table[a][b][0], said) for (a, b), (s, said) in states.items()), key=lambda v: (v[0], v[1]))
    return best[1].strip()


def restore_token(token: str, table) -> str:
    """A lower-cased token without edge marks, decoded if its lattice has more than one path."""
    bare = token.strip(PUNCTUATION)
    if len(bare) > 2 and LOOKALIKE.issuperset(bare) and not bare.isdigit():
        return viterbi(bare, table)
    core = token.strip(EDGE)
    if core and core is not token and len(token) > len(core):
        # a sign that can be a letter stays where it touches the word: $tupid, @sshole, clas$
        at = token.find(core)
        if at and token[at - 1] in "$@(" and (at < 2 or token[at - 2] not in EDGE):
            core = token[at - 1] + core
        end = at + len(token.strip(EDGE))
        if end < len(token) and token[end] in "$" and (end + 1 == len(token) or token[end + 1] not in EDGE):
            core += token[end]
    if core.isalpha() and not RUN.search(core) and all(c in CODE for c in core):
        return core
    if not any(c.isalpha() for c in core):
        return core
    return viterbi(core, table)


def squeeze(word: str) -> str:
    return PAIR.sub(r"\1", word)


def word_features(word: str) -> list[str]:
    w = squeeze(word)
    return [w] + [f"{w[:n]}*" for n in PREFIXES if len(w) > n]


def spaced_runs(tokens: list[str]) -> list[str]:
    """Runs of three or more tokens of one character each, their characters set apart by blanks."""
    n = np.fromiter(map(len, tokens), np.int64, len(tokens))
    one = np.concatenate([[0], (n == 1).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(one))
    return [" ".join(tokens[a:b]) for a, b in edges.reshape(-1, 2).tolist() if b - a >= 3 and any(t.isalpha() for t in tokens[a:b])]


def restore(text: str, table, memo: Memo | None = None) -> str:
    """The restored text: its tokens decoded, spaced letters joined."""
    memo = memo if memo is not None else Memo(lambda t: restore_token(t, table))
    tokens = text.lower().split()
    n = [len(t) == 1 for t in tokens]
    out, k = [], 0
    while k < len(tokens):
        end = k
        while end < len(tokens) and n[end]:
            end += 1
        if end - k >= 3 and any(t.isalpha() for t in tokens[k:end]):
            out.append(viterbi(" ".join(tokens[k:end]), table))
            k = end
        else:
            out.append(memo[tokens[k]])
            k += 1
    return " ".join(x for x in out if x)


def features_of_token(token: str, table) -> tuple[str, ...]:
    return tuple(f for w in restore_token(token, table).split() for f in word_features(w))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_LABELLED) -> dict:
    """Character model over all documents, lexicon over the labelled sample."""
    table = CharModel(character_counts(docs)).table()
    sample = labelled_sample(docs, labels, label, most)

    def run(texts: list[str]) -> dict[str, list]:
        memo = Memo(lambda t: features_of_token(t, table))
        out = []
        for t in texts:
            tokens = t.lower().split()
            found = {f for w in set(tokens) for f in memo[w]}
            for r in set(spaced_runs(tokens)):
                found.update(f for w in viterbi(r, table).split() for f in word_features(w))
            out.append(list(found))
        return {"features": out}

    sample = sample.groupBy("text").agg(F.max("y").alias("y"))  # copies of a text count once
    rows = materialize(map_rows(sample, ["text"], run, {"features": "array<string>"}, keep=["y"]), "toxicity-features")
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("pos")).first()
    prior = (totals.pos + 1) / (totals.n + 10)
    z2 = CONFIDENCE**2
    p, n = F.col("pos") / F.col("n"), F.col("n")
    low = (p + z2 / (2 * n) - CONFIDENCE * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    stats = rows.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).withColumn("low", low)
    got = stats.filter((F.col("low") >= LEAST_SHARE) & (F.col("low") > 2 * prior)).orderBy(F.desc("low"), "f").collect()
    chosen = {r.f: k for k, r in enumerate(got)}

    def keep(found: list[list[str]]) -> dict[str, list]:
        return {"ids": [sorted(chosen[f] for f in fs if f in chosen) for fs in found]}

    kept = map_rows(rows, ["features"], keep, {"ids": "array<int>"}, keep=["y"]).toArrow()
    release(rows)
    bias, weights = logistic(kept["ids"].to_pylist(), kept["y"].to_numpy(), len(chosen))
    alone = {r.f: math.log(low / (1 - low)) for r in got if (low := min(r.low, 0.999)) >= ALONE and not r.f.endswith("*")}
    return {"table": table, "prior": bias, "lexicon": {f: weights[k] for f, k in chosen.items()}, "alone": alone}


def logistic(ids: list[list[int]], y: np.ndarray, n: int, steps: int = 600, rate: float = 0.3, decay: float = 0.02) -> tuple[float, list[float]]:
    """Bias and weights of a logistic regression on present features: full-batch AdaGrad, weights decayed in proportion to 1 / rows."""
    if not len(y):
        return math.log(0.1 / 0.9), [0.0] * n
    row = np.repeat(np.arange(len(y)), [len(i) for i in ids])
    col = np.array([k for i in ids for k in i], np.int64)
    order = np.lexsort((row, col))  # sums do not depend on the order of the rows that came in
    row, col = row[order], col[order]
    w, b, gw, gb = np.zeros(n), math.log((y.sum() + 1) / (len(y) - y.sum() + 9)), np.full(n, 1e-8), 1e-8
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(b + np.bincount(row, w[col], minlength=len(y))))) - y
        dw, db = np.bincount(col, g[row], minlength=n) + decay * w, g.sum()
        gw += dw * dw
        gb += db * db
        w -= rate * dw / np.sqrt(gw)
        b -= rate * db / np.sqrt(gb)
    return float(b), w.round(6).tolist()


def score_documents(docs: DataFrame, model: dict, text: str = "text", out: str = "score", restored: str | None = None) -> DataFrame:
    """Add the toxicity of each whole text and, if ``restored`` names a column, the restored text."""
    table, lexicon, prior, alone = model["table"], model["lexicon"], model["prior"], model["alone"]
    kept: dict[int, Memo] = {}

    def hits(token: str):
        return tuple(f for f in features_of_token(token, table) if f in lexicon)

    def run(texts: list[str | None]) -> dict[str, list]:
        memo = kept.setdefault(0, Memo(hits))
        scores = []
        for t in texts:
            tokens = (t or "").lower().split()
            found = set()
            for h in map(memo.__getitem__, tokens):
                if h:
                    found.update(h)
            for r in spaced_runs(tokens):
                found.update(f for w in viterbi(r, table).split() for f in word_features(w) if f in lexicon)
            z = max(-30.0, prior + sum(sorted(lexicon[f] for f in found)), *(alone[f] for f in found if f in alone))
            scores.append(1 / (1 + math.exp(-min(30.0, z))))
        made = {out: scores}
        return made | ({restored: [None if t is None else restore(t, table) for t in texts]} if restored else {})

    return map_rows(docs, [text], run, {out: "double"} | ({restored: "string"} if restored else {}))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, read_table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
