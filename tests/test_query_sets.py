"""Search queries over the stated query set: every id divisible by 50, against all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from granary.operators import retrieval as R
from granary.plans import queries as plans

BUILT = "dense_knn_top30 filtered_knn sparse_dot_top30 hybrid_rrf_top12 variant_merge_rrf rerank_sigmoid coverage_gate dominant_lookup doc_order_context section_suggestions seed_entities_top6 graph_source_append abstain_message".split()


def test_every_search_query_has_one_over_the_stated_set():
    for name in BUILT:
        sql = plans.SQL[f"{name}_every50"]
        assert f"{name}_every50" in plans.QUERIES and "% 50 = 0" in sql and "vec_id < " not in sql and "item_id < " not in sql


@pytest.mark.parametrize("name", ["dense_knn_top30_every50", "filtered_knn_every50"])
@pytest.mark.parametrize("most", [10_000, 3])
def test_dense_queries_equal_brute_force(spark, sf_dir, monkeypatch, name, most):
    monkeypatch.setattr(R, "MOST_QUERIES", most)  # with 3, queries go in several blocks
    e, d = (pd.read_parquet(f"{sf_dir}/{t}.parquet") for t in ("embeddings", "documents"))
    v = np.stack(e.embedding.to_numpy()).astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = e.vec_id.to_numpy()
    keep = np.isin(ids, d.doc_id[d.lang == "en"]) if name.startswith("filtered") else np.ones(len(ids), bool)
    want = {}
    for q in np.flatnonzero(ids % 50 == 0):
        score = np.round(v[keep] @ v[q], 6)
        want[int(ids[q])] = np.sort(score)[::-1][:30]
    got = plans.QUERIES[name](spark, sf_dir).toPandas()
    assert set(got.query_id) == set(want) and len(want) == len(ids) // 50 and set(got.doc_id) <= set(ids[keep])
    for q, rows in got.groupby("query_id"):
        assert np.allclose(rows.sort_values("rank").score, want[q], atol=2e-6)
