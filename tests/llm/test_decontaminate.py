from __future__ import annotations

import random

import pytest

from granary.llm import decontaminate as D


def search(item, text):
    last = [0] * (len(text) + 1)
    for k, a in enumerate(item, 1):
        row = [k]
        for j, b in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
        last = row
    return min(last)


def test_edit_search():
    r = random.Random(0)
    for _ in range(2000):
        a, b = [r.randrange(4) for _ in range(r.randint(1, 70))], [r.randrange(4) for _ in range(r.randint(0, 40))]
        assert D.edit_search(a, b)[0] == search(a, b)


def noisy(r, words, edits):
    w = list(words)
    for _ in range(edits):
        k, p = r.random(), r.randrange(len(w))
        if k < 1 / 3:
            w[p] = f"new{r.randrange(999)}"
        elif k < 2 / 3:
            w.insert(p, f"new{r.randrange(999)}")
        elif len(w) > 1:
            del w[p]
    return w


def test_recall_against_brute_force():
    r = random.Random(1)
    vocabulary = [f"t{k}" for k in range(300)]
    items = [" ".join(r.choice(vocabulary) for _ in range(r.randint(6, 60))) for _ in range(60)]
    block = D.Items(list(range(60)), items)
    docs = []
    for _ in range(250):
        w = items[r.randrange(60)].split()
        filler = lambda: [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        docs.append(" ".join(filler() + noisy(r, w, r.randint(0, len(w) // 5 + 2)) + filler()))
    found = D.matches(block, docs)
    want = got = 0
    for doc, ms in zip(docs, found, strict=True):
        have = {m[0]: m[1] for m in ms}
        words = doc.split()
        for k, item in enumerate(items):
            best = search(item.split(), words)
            if best <= D.max_edits(len(item.split())):
                want += 1
                got += have.get(k) is not None
                assert have.get(k, best) >= best
            else:
                assert k not in have  # verification is exact
    assert want > 150 and got / want >= 0.95


ITEMS = [(1, "The quick brown fox jumps over the lazy dog, again and again until dawn breaks."), (2, "Short one here"), (3, None), (4, "!!!"), (5, ""), (None, "an item without an id has seven words")]


def test_rows(spark, make_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = ["start THE quick, brown fox jumps over the lazy dog again & again until dawn breaks end", "the quick brown cat jumps over a lazy dog again and again until dawn breaks", "quick brown fox", None, "", "say short one here now", "short one there", "x an item without an id has seven words"]
    docs = make_docs(texts, [1, 2, 3, 4, None, 6, 7, 1]).selectExpr("*", "'mine' as leaks")
    got = [[x.item_id for x in r.leaks] for r in D.find_leaks(docs, items).collect()]
    assert got == [[1], [1], [], [], [], [2], [], [None]]
    kept = D.decontaminate(docs, items).collect()
    assert len(kept) == 4 and kept[0].leaks == "mine"
    assert D.find_leaks(docs.limit(0), items).count() == 0
    assert D.decontaminate(docs, items.limit(0)).count() == len(texts)


def test_items_in_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 40)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.find_leaks(make_docs(["say short one here now", "nothing"]), items).collect()
    assert [[x.item_id for x in r.leaks] for r in got] == [[2], []]


@pytest.mark.parametrize("text", ["the the the " * 5000, "a" * 100_000])
def test_long_texts(text):
    D.matches(D.Items([1], ["was the the the shonly onst ble onor"]), [text])
