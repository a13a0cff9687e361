from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from granary.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    i, _, lang, source, n = row
    return sha("".join(map(part, (i, source, lang, n, text))))


def tree(nodes):
    """Root, and for each leaf its list of (before, after)."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            run = at // 16 * 16
            paths[k].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 16])))
            where[k] = at // 16
        nodes = [sha("".join(nodes[a : a + 16])) for a in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in sources:
        members = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        own[s] = members, *tree([leaf(r, r[1]) for r in members])
    root, above = tree([own[s][1] for s in sources])
    out = []
    for s, up in zip(sources, above, strict=True):
        members, sub, paths = own[s]
        for r, p in zip(members, paths, strict=True):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for a, b in p + up:
                node = sha(a + node + b)
            out.append((r[0], leaf(r, r[1]), sub, root, sha("".join(a + b for a, b in p + up)), node, node == root))
    return out


def rows_of(df):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    return sorted((tuple(r) for r in df.collect()), key=key), key


def same(df, rows):
    got, key = rows_of(M.manifest(df))
    assert got == sorted(brute(rows), key=key)
    return got


def test_against_plain_python(spark):
    sizes = [1, 2, 16, 17, 256, 257, 1000]  # around a run, around a block, and two rounds of blocks
    rows = [(k, f"Text {k} ÉA", "en", f"source{n}", k) for k, n in enumerate(n for n in sizes for _ in range(n))]
    got = same(spark.createDataFrame(rows, SCHEMA).repartition(5), rows)
    assert {r[6] for r in got} == {True, False}


def test_edges(spark):
    rows = [(None, "A", "en", "s", 1), (None, None, None, None, None), (0, "", "", "", 0), (1, None, "en", "é", 3), (2, "Ab" * 200_000, "en", "z", 4), (3, "Same", "en", "s", 1), (3, "Same", "en", "s", 1), (3, "Other", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    same(df, rows)
    clash = df.withColumns({c: F.lit("x") for c in ("node", "g", "pos", "block", "leaf", "root", "levels", "path")})
    assert rows_of(M.manifest(clash))[0] == rows_of(M.manifest(df))[0]


def test_many_sources(spark):
    rows = [(k, "T", "en", f"s{k}", 1) for k in range(300)]
    same(spark.createDataFrame(rows, SCHEMA), rows)


def test_empty(spark):
    out = M.manifest(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 0
