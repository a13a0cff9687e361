"""Model providers behind Arrow batches, with deterministic offline defaults.

The defaults make plans testable without model files; they claim no model quality.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

Encoder = Callable[[list[str]], np.ndarray]


def hashed_encoder(size: int = 64) -> Encoder:
    """Unit vectors of signed hashed words; texts are encoded as they are, without a prefix."""

    def encode(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), size), np.float32)
        for k, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[k, h % size] += 1.0 if h >> 16 & 1 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return encode


def encode(rows: DataFrame, key: str, text: str, encoder: Encoder | None = None) -> DataFrame:
    """(key, embedding) by an encoder that is made once for each Python worker."""
    fn = encoder or hashed_encoder()
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = fn(b.column(1).to_pylist())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=[key, "embedding"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")


def give_back() -> None:
    """Hand memory that numpy and Arrow have freed back to the system: workers are kept for later stages, which would add theirs to it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def verbatim_generator(question: str, sources: list[str]) -> str:
    """Offline generator: quotes the first source."""
    return f"{sources[0]} [S1]" if sources else ""


#: How many first sources a generator looks at; one that doesn't say so is given all.
verbatim_generator.reads = 1


def generate(rows: DataFrame, generator: Callable[[str, list[str]], str] = verbatim_generator, out: str = "answer", kept: tuple[str, ...] = (), once: bool = False) -> DataFrame:
    """rows: query_id, question, sources array<string> -> query_id, answer and the columns ``kept``. A generator that fails once is asked again, then the first source is quoted.

    With ``once`` also ``mark``, the answer's SHA-256, and an answer that the task has given before is null.
    """

    def marked(answers: list, seen: set) -> dict[str, list]:
        marks = [None if a is None else hashlib.sha256(a.encode("utf-8", "surrogatepass")).hexdigest() for a in answers]
        return {out: [None if m in seen else seen.add(m) or a for m, a in zip(marks, answers, strict=True)], "mark": marks}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for b in batches:
            answers = []
            give_back()
            for q, s in zip(b["question"], b["sources"], strict=True):
                s = [] if s is None else list(s)
                try:
                    answers.append(generator(q, s))
                except Exception:  # any provider may fail; it is asked once more
                    try:
                        answers.append(generator(q, s))
                    except Exception:
                        answers.append(verbatim_generator(q, s))
            yield pd.DataFrame({"query_id": b["query_id"]} | (marked(answers, seen) if once else {out: answers}) | {c: b[c] for c in kept})

    kind = rows.schema["query_id"].dataType.simpleString()
    passed = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select("query_id", "question", "sources", *kept).mapInPandas(run, f"query_id {kind}, {out} string{', mark string' if once else ''}{passed}")


def transliterate(text):
    """Optional transliteration of a question to Devanagari: a Column function that answers null, so the variant is left out; pass another where one is at hand."""
    from pyspark.sql import functions as F

    return F.nullif(text, text)
