from __future__ import annotations

import pytest

from granary.llm import chat_format as C

CALLS = "conv_id long, call_id string, turn long, answered_turn long, refs array<string>"


def test_chains_of_any_length_get_their_level(spark):
    n = 1100
    chain = [(1, f"c{k}", k, k + 1, [f"c{k - 1}"] if k else []) for k in range(n)]
    ring = [(2, "a", 0, None, ["b"]), (2, "b", 1, None, ["a"]), (2, "c", 2, None, ["b"]), (2, "d", 3, None, ["nowhere"])]
    got = {(r.conv_id, r.call_id): (r.level, r.order_turn) for r in C.levels(spark.createDataFrame(chain + ring, CALLS), 2).collect()}
    assert got == {(1, f"c{k}"): (2 * k, k) for k in range(n)} | {(2, "d"): (0, 3)}


@pytest.mark.parametrize("rounds", [1, 3])
def test_following_equals_joining(spark, rounds):
    rows = [(c, f"k{k}", (k * 7) % 11, None if k % 3 else (k * 5) % 13, [f"k{j}" for j in range(k) if (j * k + c) % 4 == 0] + (["k9"] if k == 8 and c else [])) for c in range(3) for k in range(12)]
    calls = spark.createDataFrame(rows, CALLS)
    assert sorted(C.levels(calls, rounds).collect()) == sorted(C.levels(calls, 100).collect())


def test_large_conversations_go_on_by_joins(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_FOLLOWED", 3)
    rows = [(c, f"k{k}", k, None, [f"k{k - 1}"] if k else []) for c, n in ((0, 7), (1, 3)) for k in range(n)]
    got = {(r.conv_id, r.call_id): r.level for r in C.levels(spark.createDataFrame(rows, CALLS), 1).collect()}
    assert got == {(c, f"k{k}"): 2 * k for c, n in ((0, 7), (1, 3)) for k in range(n)}
