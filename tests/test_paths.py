"""Search from both ends against the search from the source alone and plain walking."""

import numpy as np
import pytest

from lightgraph.operators import rag
from lightgraph.operators.graph import Graph, complete_edges, complete_nodes


def made(spark, n, ends):
    nodes = spark.range(n).select(rag.F.col("id").alias("node_id"))
    edges = spark.createDataFrame([(s, d, p, 0.1, 0) for s, d, p in ends], "src long, dst long, pos int, attenuation double, bin int")
    return Graph(complete_nodes(nodes), complete_edges(edges)).materialized()


def walked(ends, source, target, depth):
    """The shortest path, first in walking order."""
    level = [([], [source])]
    for hops in range(depth + 1):
        if any(p[-1] == target for _, p in level):
            return min((s, p) for s, p in level if p[-1] == target)[1]
        level = [(s + [pos], p + [d]) for s, p in level for a, d, pos in ends if a == p[-1] and d not in p]
    return None


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_plain_walking(spark, seed):
    rng = np.random.default_rng(seed)
    n, ends, places = 14, [], {}
    for _ in range(26):
        s, d = (int(x) for x in rng.integers(0, n, 2))
        ends.append((s, d, places.get(s, 0)))
        places[s] = places.get(s, 0) + 1
    graph = made(spark, n, ends)
    for source, target in [(0, 9), (3, 3), (5, 1), (2, 99)]:
        got = [r.path for r in rag.reasoning_path(graph, source, target, 4).collect()]
        want = walked(ends, source, target, 4)
        assert got == ([want] if want is not None and target < n else [])


def test_depth_bounds_the_path(spark):
    graph = made(spark, 6, [(i, i + 1, 0) for i in range(5)])
    assert [r.path for r in rag.reasoning_path(graph, 0, 4, 4).collect()] == [[0, 1, 2, 3, 4]]
    assert rag.reasoning_path(graph, 0, 5, 4).count() == 0 and rag.reasoning_path(graph, 4, 0, 4).count() == 0


def test_meets_before_the_hub(spark):
    """The source's tree widens at its second hop; the target has one edge in. Ties go to the first place, and few rows are written."""
    ends = [(0, 1, 0), (0, 2, 1), (1, 3, 1), (2, 3, 0), (3, 4, 0)] + [(1, 10 + i, i + 2) for i in range(200)] + [(2, 10 + i, i + 1) for i in range(200)]
    graph = made(spark, 300, ends)
    found, seen = rag.meeting_path(graph, 0, 4, 4)
    assert [r.path for r in found.collect()] == [[0, 1, 3, 4]]
    assert seen < 10 < 200 < rag.paths_from(graph, [0], 4, target=4).count()
