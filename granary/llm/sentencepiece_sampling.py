"""SentencePiece encoding and decoding: segmentations sampled without replacement (Gumbel top-k).

A text's lattice has an edge for each vocabulary piece that matches at a place; a character that no
piece spells alone goes through its bytes. A piece of rank r weighs ``log(1 / (r + OFFSET)) * alpha``
(the model file holds ranks, not probabilities), which makes a distribution over all segmentations.
No piece has a blank after another character, so the lattice is a chain of short ones, one for each
word, and equal words of a batch share theirs. Backward sums give each node's exact log mass.

The k segmentations with the largest Gumbel-perturbed log-probability are k samples without
replacement. They are found by A-star search with the exact bound: the queue holds groups of
continuations (all children of a node but those already taken), each with the maximum of its
perturbed values, drawn from a Gumbel distribution at the group's log mass truncated at its parent's
value. The best group is popped, a child is drawn, and the rest of the path follows the node masses;
the groups beside this path join the queue. Each sample costs time in proportion to the text.

The (k+1)-th value is the threshold kappa; a sample's inclusion score is
1 - exp(-exp(log_prob - kappa)), 1 if there are no more than k segmentations. Random numbers are
counters hashed with the row key, so results do not depend on partitioning or on other rows.

Null and empty texts have one segmentation, without pieces. Rows with equal keys and texts get equal
samples. An empty table gives an empty result. Extra columns pass through; one named like the new
column is replaced. The path of the vocabulary file is a parameter; it is read on the driver.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read_table
from .wordhash import GOLD, Hasher, U, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
OFFSET, ALPHA, SAMPLES, SEED = 2.7, 1.0, 2, 17
#: Bytes of text that share lattices; a worker holds about 100 times as much while it samples.
BATCH = 5 << 18
#: Characters of distinct words whose lattices are built at a time.
PART = 1 << 16
#: Rank given to pieces without one (runs of blanks).
BLANK_RANK = 40.0
EMPTY = U((1 << 64) - 1)
SPACE, ESCAPED = "▁", "\ud800"  # the second stands for a literal U+2581 of the text, which only bytes can spell


def vocabulary(path: str = MODEL) -> dict:
    """Pieces (text, id, rank) and byte ids of a SentencePiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], [0] * 256
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            score = sp.get_score(i)
            pieces.append((sp.id_to_piece(i), i, -score if score > -1e8 else BLANK_RANK))
    return {"pieces": pieces, "bytes": byte_ids, "size": sp.get_piece_size(), "digest": zlib.crc32(repr((pieces, byte_ids)).encode())}


class Codec:
    """The vocabulary as arrays: a trie for encoding, byte strings for decoding."""

    def __init__(self, vocab: dict, alpha: float = ALPHA):
        edges: dict[tuple[int, str], int] = {}
        self.deepest = max(len(p) for p, _, _ in vocab["pieces"])
        piece_of, weight_of = [-1], [0.0]
        for text, i, rank in vocab["pieces"]:
            s = 0
            for c in text:
                if (s, c) not in edges:
                    edges[s, c] = len(piece_of)
                    piece_of.append(-1)
                    weight_of.append(0.0)
                s = edges[s, c]
            piece_of[s], weight_of[s] = i, -alpha * float(np.log(rank + OFFSET))
        key = np.array([s << 21 | ord(c) for s, c in edges], np.uint64)
        bits = 19
        self.shift = U(64 - bits)
        self.slot_key, self.slot_to = np.full(1 << bits, EMPTY), np.zeros(1 << bits, np.int32)
        self.probes = 1
        for k, slot, to in zip(key.tolist(), ((key * GOLD) >> self.shift).tolist(), edges.values(), strict=True):
            tries = 1
            while self.slot_key[slot] != EMPTY:
                slot, tries = (slot + 1) % (1 << bits), tries + 1
            self.slot_key[slot], self.slot_to[slot] = k, to
            self.probes = max(self.probes, tries)
        self.root = np.zeros(0x110000, np.int32)
        for (s, c), to in edges.items():
            if s == 0:
                self.root[ord(c)] = to
        self.piece_of, self.weight_of = np.array(piece_of, np.int32), np.array(weight_of)
        self.byte_weight = -alpha * float(np.log(max(r for _, _, r in vocab["pieces"]) + OFFSET))
        self.byte_ids = np.array(vocab["bytes"], np.int32)
        spelled = [b""] * vocab["size"]
        for text, i, _ in vocab["pieces"]:
            spelled[i] = text.replace(SPACE, " ").encode()
        for b, i in enumerate(vocab["bytes"]):
            spelled[i] = bytes([b])
        self.spelled, self.spell_len = np.frombuffer(b"".join(spelled), np.uint8), np.array([len(x) for x in spelled])
        self.spell_at = np.r_[0, np.cumsum(self.spell_len)][:-1]

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next trie state, 0 where there is none."""
        key = state.astype(np.uint64) << U(21) | char.astype(np.uint64)
        slot = ((key * GOLD) >> self.shift).astype(np.int64)
        there = self.slot_key[slot]
        out = np.where(there == key, self.slot_to[slot], 0)
        look = np.flatnonzero((there != key) & (there != EMPTY))
        for p in range(1, self.probes):
            at = (slot[look] + p) % len(self.slot_key)
            there = self.slot_key[at]
            hit = there == key[look]
            out[look[hit]] = self.slot_to[at[hit]]
            look = look[~hit & (there != EMPTY)]
            if not len(look):
                break
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes that a sequence of ids spells, with the blank in front of the text."""
        n = self.spell_len[ids]
        at = np.repeat(self.spell_at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.spelled[at].tobytes()


def distinct_words(cp: np.ndarray, start: np.ndarray, size: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each word, characters of the distinct words, their lengths). Words are told apart by hash and compared in full."""
    h = hasher.spans((cp + 1).astype(np.uint64) * GOLD, start, start + size)
    _, chosen, number = np.unique(h, return_index=True, return_inverse=True)
    lengths = size[chosen]
    ends = np.cumsum(lengths)
    words = cp[np.repeat(start[chosen] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
    at = np.repeat((ends - lengths)[number] - start, size) + np.arange(len(cp))
    if (lengths[number] != size).any() or (words[np.minimum(at, max(0, len(words) - 1))] != cp).any():  # a collision
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(cp[a : a + n].tobytes(), len(known)) for a, n in zip(start.tolist(), size.tolist(), strict=True)], np.int64)
        lengths = np.array([len(w) // 4 for w in known], np.int64)
        words = np.frombuffer(b"".join(known), np.int32)
    return number, words, lengths


MADE: dict[tuple, tuple[Codec, Hasher]] = {}


def shared_codec(vocab: dict, alpha: float) -> tuple[Codec, Hasher]:
    """One codec for each vocabulary and worker process."""
    key = (vocab["digest"], alpha)
    if key not in MADE:
        MADE.clear()
        MADE[key] = Codec(vocab, alpha), Hasher()
    return MADE[key]


class Lattice:
    """Lattices of distinct words: nodes are characters, cells are pieces that start at a node. Built in parts that fit in cache."""

    def __init__(self, codec: Codec, cp: np.ndarray, size: np.ndarray):
        """cp: the characters of all words; size: the length of each."""
        stop = np.cumsum(size)
        self.first, self.cp = stop - size, cp
        cuts = np.unique(np.r_[0, np.searchsorted(stop, np.arange(PART, len(cp), PART)), len(size)])
        parts = [Part(codec, cp[self.first[a] : stop[b - 1]], size[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        nodes = np.cumsum([0] + [len(p.cp) for p in parts])[:-1].astype(np.int32)

        def take(name: str, shift: bool = False) -> np.ndarray:  # each array leaves the parts as it is joined
            return np.concatenate([p.__dict__.pop(name) + n if shift else p.__dict__.pop(name) for p, n in zip(parts, nodes, strict=True)])

        self.piece, self.is_last, self.logp, self.upto, self.count = map(take, ("piece", "is_last", "logp", "upto", "count"))
        self.node, self.after = take("node", True), take("after", True)
        self.begin = np.r_[0, np.cumsum(self.count)].astype(np.int32)

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """A cell of each node by its probability; u in [0, 1)."""
        cell, last = self.begin[node].copy(), self.begin[node + 1] - 1
        todo = np.flatnonzero((cell < last) & (self.upto[cell] <= u))
        while len(todo):
            cell[todo] += 1
            c = cell[todo]
            todo = todo[(c < last[todo]) & (self.upto[c] <= u[todo])]
        return cell


class Part:
    """The lattices of some words. ``after`` of a word's last cell means nothing."""

    def __init__(self, codec: Codec, cp: np.ndarray, size: np.ndarray):
        """cp: the characters of all words; size: the length of each."""
        stop = np.cumsum(size)
        self.first = stop - size
        left = (np.repeat(stop, size) - np.arange(len(cp))).astype(np.int32)  # characters to the word's end
        found: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []  # nodes, length, weights, pieces
        at, state = np.arange(len(cp), dtype=np.int32), np.zeros(0, np.int32)
        for n in range(1, codec.deepest + 1):
            state = codec.root[cp] if n == 1 else codec.step(state, cp[at + (n - 1)])
            live = state > 0
            at, state = at[live], state[live]
            hit = codec.piece_of[state] >= 0
            found.append((at[hit], n, codec.weight_of[state[hit]], codec.piece_of[state[hit]]))
            if n == 1:  # characters that no piece spells alone go through their bytes; piece -1
                alone = np.ones(len(cp), bool)
                alone[at[hit]] = False
                bare = np.flatnonzero(alone).astype(np.int32)
                c = np.where(cp[bare] == ord(ESCAPED), ord(SPACE), cp[bare])
                width = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
                found.append((bare, 1, width * codec.byte_weight, np.full(len(bare), -1, np.int32)))
            go = left[at] > n
            at, state = at[go], state[go]
            if not len(at):
                break
        count = np.zeros(len(cp), np.int32)
        for nodes, *_ in found:
            count[nodes] += 1
        self.begin = np.r_[0, np.cumsum(count)].astype(np.int32)
        filled = self.begin[:-1].copy()
        total = int(self.begin[-1])
        weight, self.piece, self.after = np.zeros(total), np.zeros(total, np.int32), np.zeros(total, np.int32)
        for nodes, n, w, ids in reversed(found):  # cells of a node by falling length: long pieces are likely
            slot = filled[nodes]
            weight[slot], self.piece[slot], self.after[slot] = w, ids, nodes + np.int32(n)
            filled[nodes] += 1
        self.node = np.repeat(np.arange(len(cp), dtype=np.int32), count)
        self.cp, self.count = cp, count
        # backward log masses, all words at once by distance from the end; a word's end has mass one
        self.is_last = self.after == np.repeat(stop, size).astype(np.int32)[self.node]
        self.after[self.is_last] = len(cp)
        mass = np.zeros(len(cp) + 1)
        by_size = np.argsort(-size, kind="stable")
        ends, sizes = stop[by_size], size[by_size]
        for d in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            nodes = ends[: np.searchsorted(-sizes, -d, side="right")] - d
            c = count[nodes]
            start = np.cumsum(c) - c
            cells = np.repeat(self.begin[nodes] - start, c) + np.arange(c.sum())
            v = weight[cells] + mass[self.after[cells]]
            top = np.maximum.reduceat(v, start)
            mass[nodes] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, c)), start))
        self.logp = weight + mass[self.after] - mass[self.node]
        sums = np.r_[0.0, np.cumsum(np.exp(self.logp))]
        self.upto = sums[1:] - np.repeat(sums[self.begin[:-1]], count)  # probability of the cells of a node up to this one


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashed counters."""
    return ((mix(x) >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def counter(key, *parts) -> np.ndarray:
    """One hash from a key and further numbers."""
    h = np.asarray(key, np.uint64)
    for p in parts:
        h = mix(h ^ (np.atleast_1d(np.asarray(p, np.uint64)) * GOLD + U(0x632BE59BD9B4E019)))
    return h


def truncated_gumbel(place, top, u):
    """Gumbel variables at ``place`` given that they are at most ``top``: exp(-g) = exp(-top) + E exp(-place)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = -np.asarray(top, float), np.log(-np.log(u)) - place
        g = -np.logaddexp(a, b)
    return np.where(np.isneginf(place), -np.inf, g)


def scalar_gumbel(place: float, top: float, u: float) -> float:
    a, b = -top, math.log(-math.log(u)) - place
    return -(max(a, b) + math.log1p(math.exp(-abs(a - b))))


class Batch:
    """Samples of a batch of texts."""

    def __init__(self, codec: Codec, texts: list[str], keys: np.ndarray, hasher: Hasher | None = None):
        self.codec, hasher = codec, hasher or Hasher()
        cp = np.frombuffer("".join([f" {t}" if t else "" for t in texts]).encode("utf-32-le", "surrogatepass"), np.int32)
        sizes = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        opens = np.cumsum(sizes) - sizes
        blank = cp == 0x20
        cp = np.where(blank, ord(SPACE), np.where(cp == ord(SPACE), ord(ESCAPED), cp))
        first = blank.copy()  # a word starts with a run of blanks
        first[1:] &= ~blank[:-1]
        first[opens[sizes > 0]] = True
        start = np.flatnonzero(first)
        size = np.diff(np.r_[start, len(cp)])
        self.counts = np.diff(np.searchsorted(start, np.r_[opens, len(cp)]))
        self.word, words, lengths = distinct_words(cp, start, size, hasher)
        self.lattice = Lattice(codec, words, lengths) if len(lengths) else None
        self.n, self.keys = len(texts), keys
        self.bound = np.r_[0, np.cumsum(self.counts)].astype(np.int64)
        self.text_of = np.repeat(np.arange(self.n), self.counts)
        self.place = np.arange(len(self.word)) - self.bound[:-1][self.text_of]

    def walk(self, token: np.ndarray, node: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Follow node masses from the given node of each token to its end: (token, step, cell)."""
        out, step = [], 0
        base = counter(self.keys[self.text_of[token]], draw, self.place[token].astype(np.uint64))
        while len(token):
            u = uniform(base + U((step + 1) * int(GOLD) % (1 << 64)))
            cell = self.lattice.choose(node, u)
            out.append((token, np.full(len(token), step), cell))
            go = ~self.lattice.is_last[cell]
            token, node, base = token[go], self.lattice.after[cell[go]], base[go]
            step += 1
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (token, token, token)

    def arrange(self, token: np.ndarray, step: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells in the order of the text, and where each token's begin."""
        n = np.bincount(token, minlength=len(self.word))
        at = np.r_[0, np.cumsum(n)]
        flat = np.empty(len(cell), np.int64)
        flat[at[token] + step] = cell
        return flat, at

    def samples(self, k: int) -> list[list[dict]]:
        """Up to k samples of each text: log_prob, value (perturbed), inclusion, and the cells."""
        out: list[list[dict]] = [[] for _ in range(self.n)]
        first = -np.log(-np.log(uniform(counter(self.keys, 0, 1))))
        for t in range(self.n):
            if not self.counts[t]:
                out[t].append({"log_prob": 0.0, "value": float(first[t]), "path": -1, "begin": 0, "end": 0})
        queue: list[list] = [[] for _ in range(self.n)]
        live = np.flatnonzero(self.counts)
        tops, paths, fixed = first.copy(), [], None
        for r in range(k):
            if not len(live):
                break
            if r == 0:
                token = np.flatnonzero(self.word >= 0)
                flat, at = self.arrange(*self.walk(token, self.lattice.first[self.word[token]], r))
                fixed = np.zeros(self.n, np.int64)
            else:
                flat, at, fixed, live, tops = self.branch(live, queue, paths, out, r)
                if not len(live):
                    break
            logp = self.lattice.logp[flat]
            sums = np.r_[0.0, np.cumsum(logp)]
            begin, end = at[self.bound[:-1]], at[self.bound[1:]]
            paths.append((flat, begin))
            for t in live.tolist():
                out[t].append({"log_prob": float(sums[end[t]] - sums[begin[t]]), "value": float(tops[t]), "path": r, "begin": int(begin[t]), "end": int(end[t])})
            self.enqueue(queue, live, tops, flat, logp, sums, begin, end, fixed + (r > 0), r, k + 1 - r)
        for t in range(self.n):
            kappa = -queue[t][0][0] if queue[t] else -np.inf
            for s in out[t]:
                s["inclusion"] = 1.0 if not np.isfinite(kappa) else float(-np.expm1(-np.exp(min(50.0, s["log_prob"] - kappa))))
        self.paths = [flat for flat, _ in paths]
        return out

    def enqueue(self, queue, live, tops, flat, logp, sums, begin, end, least, r, most):
        """Queue the ``most`` best groups beside path r of each text, from place ``least`` on.

        Log masses fall along a path. -log(u) of a 53-bit number lies between exp(-37) and exp(4), so a group
        whose mass is more than 45 below that of the ``most``-th largest cannot be among the best; later ones are not drawn.
        """
        lat, reach = self.lattice, 64
        while len(live):
            lo, hi = begin[live] + least[live], np.minimum(end[live], begin[live] + least[live] + reach)
            n = np.maximum(hi - lo, 0)
            own = np.repeat(np.arange(len(live)), n)
            j = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            t = live[own]
            before = sums[j] - sums[begin[t]]
            with np.errstate(divide="ignore"):
                alt = np.where(lat.count[lat.node[flat[j]]] > 1, before + np.log1p(-np.minimum(np.exp(logp[j]), 1.0)), -np.inf)
            rows = np.full((len(live), reach), -np.inf)
            rows[own, j - np.repeat(lo, n)] = alt
            kth = -np.partition(-rows, most - 1, axis=1)[:, most - 1]
            ended = hi >= end[live]
            # at the end of what was looked at, the mass bounds all later groups
            done = ended | (sums[np.minimum(hi, len(sums) - 1)] - sums[begin[live]] < kth - 45)
            if done.any():
                pick = done[own]
                g = np.full((len(live), reach), -np.inf)
                u = uniform(counter(self.keys[t[pick]], r, 2, (j - begin[t])[pick].astype(np.uint64)))
                place = (j - np.repeat(lo, n))[pick]
                g[own[pick], place] = truncated_gumbel(alt[pick], tops[t[pick]], u)
                best = np.argsort(-g, axis=1, kind="stable")[:, :most]
                value = np.take_along_axis(g, best, 1)
                row, col = np.nonzero(np.isfinite(value) & done[:, None])
                at = lo[row] + best[row, col]
                text = live[row]
                items = zip(text.tolist(), (-value[row, col]).tolist(), (at - begin[text]).tolist(), flat[at].tolist(), (sums[at] - sums[begin[text]]).tolist(), strict=True)
                for x, g_x, spot, cell, mass in items:
                    heapq.heappush(queue[x], (g_x, r, spot, (cell,), mass))
            live, reach = live[~done], reach * 4

    def branch(self, live, queue, paths, out, r):
        """Pop the best group of each text, draw one of its children and walk on from there."""
        lat, picked = self.lattice, {}
        pick_u, again_u = uniform(counter(self.keys, r, 3)).tolist(), uniform(counter(self.keys, r, 4)).tolist()
        for t in live.tolist():
            if not queue[t]:
                continue
            value, path, spot, taken, before = heapq.heappop(queue[t])
            flat, begin = paths[path]
            node = int(lat.node[taken[0]])
            cells = [c for c in range(int(lat.begin[node]), int(lat.begin[node + 1])) if c not in taken]
            w = [math.exp(x) for x in lat.logp[cells].tolist()]
            u, child = pick_u[t] * sum(w), 0
            while child < len(cells) - 1 and u >= w[child]:
                u -= w[child]
                child += 1
            mass = sum(w[:child]) + sum(w[child + 1 :])
            child = cells[child]
            if mass > 0:
                again = scalar_gumbel(before + math.log(mass), -value, again_u[t])
                heapq.heappush(queue[t], (-again, path, spot, (*taken, child), before))
            picked[t] = (-value, path, spot, child)
        live = np.array(sorted(picked), np.int64)
        tops, fixed = np.full(self.n, -np.inf), np.zeros(self.n, np.int64)
        token, step, cell, walk_token, walk_node, lead = [], [], [], [], [], np.zeros(len(self.word), np.int64)
        for t in live.tolist():
            tops[t], path, spot, child = picked[t]
            fixed[t] = spot
            flat, begin = paths[path]
            kept = np.r_[flat[begin[t] : begin[t] + spot], child]
            place = np.r_[0, np.cumsum(lat.is_last[kept[:-1]])].astype(np.int64)  # token of each kept cell
            new = np.r_[True, place[1:] != place[:-1]]
            token.append(place + self.bound[t])
            step.append(np.arange(len(kept)) - np.flatnonzero(new)[np.cumsum(new) - 1])
            cell.append(kept)
            nxt = int(place[-1] + self.bound[t])
            if not lat.is_last[child]:
                walk_token.append(np.array([nxt]))
                walk_node.append(np.array([lat.after[child]]))
                lead[nxt] = int(step[-1][-1]) + 1
            more = np.arange(nxt + 1, self.bound[t + 1])
            walk_token.append(more)
            walk_node.append(lat.first[self.word[more]])
        if not len(live):
            return None, None, fixed, live, tops
        a, s, c = self.walk(np.concatenate(walk_token), np.concatenate(walk_node), r) if walk_token else (np.zeros(0, np.int64),) * 3
        flat, at = self.arrange(np.concatenate([*token, a]), np.concatenate([*step, s + lead[a]]), np.concatenate([*cell, c]))
        return flat, at, fixed, live, tops

    def ids(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of cells, and where each cell's ids begin; a character without a piece gives an id for each of its bytes."""
        piece = self.lattice.piece[cells] if self.lattice else np.zeros(0, np.int32)
        bare = np.flatnonzero(piece < 0)
        spelled = [chr(c).replace(ESCAPED, SPACE).encode() for c in self.lattice.cp[self.lattice.node[cells[bare]]].tolist()] if len(bare) else []
        n = np.ones(len(piece), np.int64)
        n[bare] = [len(x) for x in spelled]
        at = np.r_[0, np.cumsum(n)]
        out = np.repeat(piece, n)
        out[out < 0] = self.codec.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, at


SAMPLE_TYPE = "array<struct<rank:int,n_pieces:int,log_prob:double,value:double,inclusion:double,round_trip:boolean,ids_hash:bigint{ids}>>"


def encode_batch(codec: Codec, hasher: Hasher, texts: list[str], keys: np.ndarray, k: int, ids: bool):
    """Up to k samples of each text as an Arrow array of SAMPLE_TYPE; the paths are spelled one at a time."""
    import pyarrow as pa

    batch = Batch(codec, texts, keys, hasher)
    found = batch.samples(k)
    ends = np.r_[0, np.cumsum([len(ss) for ss in found])].astype(np.int32)
    samples = [s for ss in found for s in ss]
    text_of = np.repeat(np.arange(len(texts)), np.diff(ends))
    size, hashes, same = np.zeros(len(samples), np.int32), np.zeros(len(samples), np.int64), np.zeros(len(samples), bool)
    pieces: list[np.ndarray] = [np.zeros(0, np.int32)] * len(samples)
    path = np.array([s["path"] for s in samples], np.int64)
    raw = [t.encode() for t in texts]
    for r in range(-1, len(batch.paths)):
        mine = np.flatnonzero(path == r)
        i, at = batch.ids(batch.paths[r] if r >= 0 else np.zeros(0, np.int64))
        said, place = codec.decode(i), np.r_[0, np.cumsum(codec.spell_len[i])]
        begin, end = (at[[samples[n][side] for n in mine]] for side in ("begin", "end"))
        size[mine], hashes[mine] = end - begin, hasher.spans(mix(i.astype(np.uint64)), begin, end).view(np.int64)
        for n, x, y in zip(mine.tolist(), begin.tolist(), end.tolist(), strict=True):
            same[n] = said[place[x] : place[y]][1:] == raw[text_of[n]]
            pieces[n] = i[x:y]
    columns = {"rank": np.arange(len(samples), dtype=np.int32) - ends[text_of] + np.int32(1), "n_pieces": size}
    columns |= {c: np.array([s[c] for s in samples], np.float64) for c in ("log_prob", "value", "inclusion")}
    arrays = {c: pa.array(x) for c, x in (columns | {"round_trip": same, "ids_hash": hashes}).items()}
    if ids:
        arrays["ids"] = pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), np.concatenate([np.zeros(0, np.int32), *pieces]))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(list(arrays.values()), list(arrays)))


def sample_segmentations(docs: DataFrame, vocab: dict, keys: list[str], text: str = "text", out: str = "samples", k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Add up to k distinct sampled segmentations of each whole text, best perturbed value first.

    ``keys`` are the columns that seed a row; with ``ids`` the piece ids are returned as well.
    ``keep`` names the columns to pass through (default: all).
    """

    def run(texts: list[str | None], row_keys: list[int]) -> dict:
        codec, hasher = shared_codec(vocab, alpha)
        return {out: encode_batch(codec, hasher, [t or "" for t in texts], np.array(row_keys, np.int64).view(np.uint64), k, ids)}

    keyed = docs.withColumn("__key", F.xxhash64(F.lit(seed), *keys))
    kind = SAMPLE_TYPE.format(ids=",ids:array<int>" if ids else "")
    return map_rows(keyed, [text, "__key"], run, {out: kind}, keep=docs.columns if keep is None else keep, most=BATCH)


def decode(ids: list[int], codec: Codec) -> str:
    return codec.decode(np.array(ids, np.int64))[1:].decode("utf-8", "replace")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sample_segmentations(docs, vocabulary(), ["doc_id"], ids=True, keep=["doc_id"]).select("doc_id", F.explode("samples").alias("s"))
    return found.select("doc_id", "s.*")
