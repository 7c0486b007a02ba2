"""Queries whose result isn't cut to an id range: every row of the operator."""

import numpy as np
import pytest

import __spark_entry__ as entry
from lightgraph.plans import graphs, queries


def test_every_link_is_ranked(spark, tmp_path):
    """Against brute force on 150 vectors, so that most heads are beyond the first sixty."""
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(150, 64)), 3)
    rows = [(i, int(i % 16), v.tolist()) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = entry.queries()["link_prediction_eval"](spark, str(tmp_path)).collect()[0]
    links = queries.vector_triples(spark, str(tmp_path)).distinct().collect()
    assert sum(r.head_id >= 60 for r in links) > 200
    ranks = []
    for r in links:
        phi, h = np.array(queries.PHASES[r.angle_bin]), vectors[r.head_id]
        turned = np.concatenate([h[:32] * np.cos(phi) - h[32:] * np.sin(phi), h[:32] * np.sin(phi) + h[32:] * np.cos(phi)])
        gap = turned - vectors
        d = np.sqrt(gap[:, :32] ** 2 + gap[:, 32:] ** 2 + 1e-8).sum(1)
        ranks.append(1 + sum(d[n] < d[r.tail_id] - 1e-12 for n in range(len(vectors)) if n != r.tail_id))
    ranks = np.array(ranks)
    expected = [(1 / ranks).mean(), *((ranks <= k).mean() for k in (1, 3, 10)), ranks.mean()]
    assert np.allclose([got.mrr, got.hits_1, got.hits_3, got.hits_10, got.mean_rank], expected, atol=2e-6)


@pytest.mark.parametrize("name, column, places", [
    ("portals", "src", {0, 1, 2, 3}), ("edge_lookup", "src", {0, 1, 2, 3}), ("remove_edge", "src", {0, 1, 2, 3}), ("isolate_node", "src", {0, 1, 2, 3}),
    ("update_nodes", "node_id", {0, 1, 2, 3, 4}), ("directional_luminance", "node_id", {0, 1, 2}), ("modulated_luminance", "node_id", {0, 1, 2}),
])
def test_every_type_is_there(spark, sf, name, column, places):
    """test_oracle.py holds the rows against SQL."""
    df = entry.queries()[name](spark, sf)
    assert {r[0] for r in df.selectExpr(f"floor({column} / {graphs.SPAN})").distinct().collect()} == places
