"""Words of whole texts and their 64-bit hashes, for many texts at once.

A word's hash is a polynomial in its bytes modulo 2**64, taken from prefix sums, mixed with its
length; words of over ``LONG`` bytes are hashed by XXH64 instead (a polynomial modulo a power of two
has known collisions between long periodic strings).
"""

from __future__ import annotations

import numpy as np
import xxhash

LONG = 512
#: Bytes of text that are hashed at a time; a longer word is one piece.
PIECE = 1 << 20
U = np.uint64
BASE = pow(0x9E3779B97F4A7C15, 3, 1 << 64) | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
GOLD = U(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)


class Powers:
    """Powers of a number modulo 2**64, extended as needed."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            self.known = np.multiply.accumulate(np.r_[U(1), np.full(max(n, 1 << 16) - 1, self.base, np.uint64)])
        return self.known[:n]


class Hasher:
    """Hashes of words, of runs of words, and the places of words in a buffer of texts."""

    def __init__(self):
        self.up, self.down = Powers(BASE), Powers(BASE_INVERSE)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
        """(hash, text number, start, end) of each word, and the buffer that starts and ends point into.

        The buffer holds the words of each text joined by single blanks, so equal runs of words are equal bytes.
        """
        lines = [b" ".join(t.split()) for t in texts]
        buf = b"\n".join(lines) + b"\n"
        h, starts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(buf):  # pieces end behind a word, so a long text needs little more than its own size at a time
            cut = buf.rfind(b" ", at, at + PIECE) + 1 if at + PIECE < len(buf) else len(buf)
            cut = cut or min((k for k in (buf.find(b" ", at), buf.find(b"\n", at)) if k >= 0)) + 1
            x, a, e = self.piece(buf[at:cut])
            h.append(x)
            starts.append(a + at)
            ends.append(e + at)
            at = cut
        first = np.cumsum([0] + [len(t) + 1 for t in lines])[:-1]
        start = np.concatenate(starts)
        return np.concatenate(h), np.searchsorted(first, start, side="right") - 1, start, np.concatenate(ends), buf

    def piece(self, buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.frombuffer(buf, np.uint8)
        edge = np.diff(np.r_[True, SPACE[a], True].astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.r_[U(0), np.cumsum(BYTE_VALUE[a] * self.up.upto(len(a)))]
        h = (sums[ends] - sums[starts]) * self.down.upto(len(a) + 1)[starts]
        size = (ends - starts).astype(np.uint64)
        h = mix(h ^ (size * GOLD))
        for k in np.flatnonzero(size > LONG):
            h[k] = xxhash.xxh64_intdigest(buf[starts[k] : ends[k]], 3)
        return h, starts, ends

    def spans(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """One hash for each run of words [start, end)."""
        v = mix(h + U(salt) * GOLD) if salt else h
        sums = np.r_[U(0), np.cumsum(v * self.up.upto(len(v)))]
        x = (sums[end] - sums[start]) * self.down.upto(len(v) + 1)[start]
        return mix(x ^ ((end - start).astype(np.uint64) * GOLD))


def groups(texts: list[bytes], most: int = 1 << 18) -> list[tuple[int, int]]:
    """Consecutive ranges of texts of about ``most`` bytes together."""
    out, start, total = [], 0, 0
    for k, t in enumerate(texts):
        if k > start and total + len(t) > most:
            out.append((start, k))
            start, total = k, 0
        total += len(t) + 1
    return out + [(start, len(texts))] * (len(texts) > start)
