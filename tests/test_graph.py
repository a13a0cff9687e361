"""The level-wise walk equals a first-in first-out queue."""

from __future__ import annotations

import random
import shutil

import pytest
from pyspark.sql import functions as F

from granary.operators import graph as G

PRIORITY = {t: k for k, t in enumerate(G.TYPE_PRIORITY)}


def queue_walk(kinds, edges, entries, cfg):
    near = {}
    for a, b, kind, w in edges:
        near.setdefault(a, []).append((w, b, kind))
        near.setdefault(b, []).append((w * cfg.reverse_factor, a, kind + "~"))
    best, queue = {}, [(e, 0, 1.0, None) for e in entries if e in kinds]
    while queue:
        node, hop, score, via = queue.pop(0)
        if node in best and best[node][0] >= score:
            continue
        best[node] = (score, hop, via)
        if hop >= cfg.max_hops or len(best) >= cfg.max_nodes:
            continue
        hub = hop > 0 and kinds[node] in cfg.hub_types
        found = [c for c in near.get(node, []) if not hub or kinds[c[1]] in cfg.hub_expands]
        found.sort(key=lambda c: (-c[0], PRIORITY.get(kinds[c[1]], 99), c[1], c[2]))
        for w, to, kind in found[: cfg.hub_fan_out if hub else cfg.fan_out]:
            queue.append((to, hop + 1, score * w * cfg.decay, kind))
    ranked = sorted(best.items(), key=lambda x: (-round(x[1][0], 9), x[1][1], x[0]))[: cfg.max_nodes]
    return [(n, round(s, 9), h, v) for n, (s, h, v) in ranked]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("caps", [{}, {"max_nodes": 6, "fan_out": 3, "hub_fan_out": 2}, {"max_hops": 3, "max_nodes": 40}])
def test_walk_equals_queue(spark, seed, caps):
    r = random.Random(seed)
    kinds = {f"n{k}": r.choice(G.TYPE_PRIORITY) for k in range(30)}
    edges = list({(a, b, k): (a, b, k, G.EDGE_WEIGHTS[k]) for a, b, k in ((r.choice(list(kinds)), r.choice(list(kinds)), r.choice(list(G.EDGE_WEIGHTS))) for _ in range(70)) if a != b}.values())
    entries = r.sample(list(kinds), 3)
    cfg = G.WalkConfig(**caps)
    nodes = spark.createDataFrame(list(kinds.items()), "concept_id string, entity_type string")
    e = spark.createDataFrame(edges, "src string, dst string, kind string, w double")
    starts = spark.createDataFrame([(7, x, k + 1) for k, x in enumerate([*entries, "unknown"])], "query_id long, concept_id string, pos int")
    got = G.walk(nodes, e, starts, cfg).orderBy("position").collect()
    assert [(x.concept_id, x.score, x.hop, x.via) for x in got] == queue_walk(kinds, edges, entries, cfg)


def test_empty_graph(spark):
    nodes = spark.createDataFrame([], "concept_id string, entity_type string")
    edges = spark.createDataFrame([], "src string, dst string, kind string, w double")
    starts = spark.createDataFrame([(0, "a", 1)], "query_id long, concept_id string, pos int")
    assert G.walk(nodes, edges, starts).count() == 0


def test_aliases_of_stopwords_or_short_are_ignored(spark):
    nodes = spark.createDataFrame([("a", ["The Policy"]), ("b", ["ABC"]), ("c", ["Food Processing"]), ("d", ["food"])], "concept_id string, aliases array<string>")
    q = spark.createDataFrame([(0, "the policy on food-processing, ABC"), (1, None), (2, "")], "query_id long, text string")
    got = G.entry_points(q, G.alias_table(nodes)).orderBy("query_id", "pos").collect()
    assert [(x.query_id, x.concept_id, x.pos) for x in got] == [(0, "c", 1), (0, "d", 2)]


def test_seeds_come_first(spark):
    nodes = spark.createDataFrame([("c", ["Food Processing"])], "concept_id string, aliases array<string>")
    q = spark.createDataFrame([(0, "food processing")], "query_id long, text string")
    seeds = spark.createDataFrame([(0, "z", 1), (0, "c", 2)], "query_id long, concept_id string, pos int")
    assert [x.concept_id for x in G.entry_points(q, G.alias_table(nodes), seeds).orderBy("pos").collect()] == ["z", "c"]


def test_config_takes_known_keys_only():
    assert G.WalkConfig.of({"fan_out": 3, "nonsense": 1}).fan_out == 3
    assert G.WalkConfig.of(None) == G.WalkConfig()


def test_aliases_of_any_length_are_found(spark):
    long = "Special Package for Women Led Units in Flood Prone Blocks of Koshi"
    nodes = spark.createDataFrame([("a", [long]), ("b", ["Flood Prone Blocks"])], "concept_id string, aliases array<string>")
    q = spark.createDataFrame([(0, f"who gets the {long.upper()}, and when?"), (1, "flood prone blocks"), (2, "")], "query_id long, text string")
    assert len(long.split()) == 12
    got = G.entry_points(q, G.alias_table(nodes)).orderBy("query_id", "pos").collect()
    assert [(x.query_id, x.concept_id) for x in got] == [(0, "a"), (0, "b"), (1, "b")]
    assert G.entry_points(q, G.alias_table(nodes.limit(0))).count() == 0


def test_a_missing_or_broken_graph_is_empty(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "act", "A", ["x"], 1)], "concept_id string, entity_type string, title string, aliases array<string>, extra int")
    edges = spark.createDataFrame([("a", "b", "in_scheme", 0.4)], "src string, dst string, kind string, w double")
    G.write_graph(nodes, edges, str(tmp_path / "g"))
    got = G.read_graph(spark, str(tmp_path / "g"))
    assert [df.count() for df in got] == [1, 1] and got[0].columns == [c.split(" ")[0] for c in G.NODE_COLUMNS.split(", ")]
    G.write_graph(nodes.withColumns({"trust": F.lit("unverified"), "chunk_ids": F.array(F.lit("c1"), F.lit("c2"))}), edges, str(tmp_path / "g"))
    row = G.read_graph(spark, str(tmp_path / "g"))[0].first()
    assert (row.trust, row.chunk_ids, row.summary) == ("unverified", ["c1", "c2"], None)
    G.write_graph(nodes, edges, str(tmp_path / "bad"))
    shutil.rmtree(next((tmp_path / "bad" / "data").glob("edges-*")))
    for folder in ("none", "bad"):
        assert [df.count() for df in G.read_graph(spark, str(tmp_path / folder))] == [0, 0]


def test_transliteration_is_optional(spark):
    from granary.providers import transliterate

    assert spark.createDataFrame([("namaste",), (None,)], "t string").select(transliterate(F.col("t"))).collect() == [(None,), (None,)]


@pytest.mark.parametrize("caps", [{}, {"max_nodes": 9, "fan_out": 2, "hub_fan_out": 3}])
def test_walk_of_many_queries_equals_the_walk(spark, caps):
    r = random.Random(5)
    kinds = {f"n{k}": r.choice(G.TYPE_PRIORITY[-4:] + G.TYPE_PRIORITY[:2]) for k in range(60)}
    edges = sorted({(f"n{r.randrange(6)}", f"n{r.randrange(60)}", k) for k in r.choices(list(G.EDGE_WEIGHTS), k=400)})
    nodes = spark.createDataFrame(list(kinds.items()), "concept_id string, entity_type string")
    e = spark.createDataFrame([(a, b, k, G.EDGE_WEIGHTS[k]) for a, b, k in edges if a != b], "src string, dst string, kind string, w double")
    starts = spark.createDataFrame([(q, f"n{r.randrange(60)}", p) for q in range(40) for p in range(1, 4)], "query_id long, concept_id string, pos int").dropDuplicates(["query_id", "concept_id"])
    cfg = G.WalkConfig(**caps)
    rows = lambda many: sorted(map(tuple, G.walk(nodes, e, starts, cfg, many).collect()))
    assert rows(True) == rows(False)
    steps = G.neighbours(e, cfg.reverse_factor).join(nodes.select(F.col("concept_id").alias("dst"), F.col("entity_type").alias("to_type")), "dst")
    most = max(x["count"] for x in G.best_steps(steps, F.lit(0), cfg).groupBy("src").count().collect())
    assert most <= 2 * max(cfg.fan_out, cfg.hub_fan_out) < max(x["count"] for x in steps.groupBy("src").count().collect())
