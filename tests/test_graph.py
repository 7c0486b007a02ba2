import pytest
from pyspark.sql import functions as F

from lightgraph.operators.graph import Graph, GraphBuilder, dense_ids
from lightgraph.params import GraphError


@pytest.fixture()
def small(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node_id long")
    edges = spark.createDataFrame([(0, 1, 0, 0.1, 2), (0, 1, 1, 0.2, 3), (0, 2, 2, 0.1, 2), (1, 2, 0, 0.1, 2), (3, 3, 0, 0.1, 2)], "src long, dst long, pos int, attenuation double, bin int")
    return Graph.of(nodes, edges)


def pairs(df):
    return [(r.src, r.dst, r.pos) for r in df.orderBy("src", "pos").collect()]


def test_defaults(small):
    r = small.nodes.orderBy("node_id").collect()[0]
    assert (r.luminance, r.reflection, r.refraction, r.default_bin, r.prop, r.dir_lum, r.room) == (1.0, 1.0, 1.0, 0, None, [1.0] * 16, 0)


def test_access(small):
    assert [r.dst for r in small.neighbors(0).collect()] == [1, 1, 2]
    assert small.edge(0, 1).collect()[0].attenuation == 0.1 and small.edge(4, 0).count() == 0
    assert tuple(small.counts().collect()[0]) == (5, 5)
    assert [(r.node_id, r.degree, r.row_ptr) for r in small.csr().orderBy("node_id").collect()] == [(0, 3, 0), (1, 1, 3), (2, 0, 4), (3, 1, 4), (4, 0, 5)]


def test_change(small):
    assert pairs(small.without_edge(0, 1).edges) == [(0, 1, 1), (0, 2, 2), (1, 2, 0), (3, 3, 0)]
    assert small.without_edge(4, 4).edges.count() == 5
    assert pairs(small.isolate(2).edges) == [(0, 1, 0), (0, 1, 1), (3, 3, 0)]
    assert pairs(small.with_edge(4, 0, 0.3, 7).edges)[-1] == (4, 0, 0)
    r = small.with_edge_props(0, 1, 0.9, 9).edge(0, 1).collect()[0]
    assert (r.attenuation, r.bin) == (0.9, 9)
    assert sorted(r.node_id for r in small.isolated().collect()) == [4]  # an edge to itself is an edge out
    with pytest.raises(GraphError):
        small.with_edge(0, 77)


def test_overrides(spark, small):
    over = spark.createDataFrame([(1, 3.0, None), (2, None, "IsA")], "node_id long, luminance double, prop string")
    got = {r.node_id: (r.luminance, r.prop) for r in small.with_nodes(over).nodes.collect()}
    assert got[1] == (3.0, None) and got[2] == (1.0, "IsA") and got[0] == (1.0, None)
    with pytest.raises(GraphError):
        small.with_nodes(spark.createDataFrame([(99, 1.0)], "node_id long, luminance double"))


def test_validation(spark, small):
    small.validate()
    bad = Graph(small.nodes, small.edges.unionByName(spark.createDataFrame([(0, 42, 0, 2.0, 16, False)], small.edges.schema)))
    assert {r.rule for r in bad.violations().where("n > 0").collect()} == {"unknown node", "bin out of range", "attenuation out of range", "repeated place"}
    with pytest.raises(GraphError):
        bad.validate()
    with pytest.raises(GraphError):
        Graph.empty(spark, 0)


def test_builder(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "x"), (None, "y")], "u string, v string")
    graph = GraphBuilder(spark).add_node("extra", "odd", 4.0).add_nodes(rows, "v", "shop").add_edges(rows, "u", "v", "user", "shop", "purchased", 0.2, True).add_edge("extra", "shop:y", "is_a").add_edge("extra", "nobody", "is_a").build()
    nodes = {r.label: r for r in graph.nodes.collect()}
    assert sorted(nodes) == ["extra", "shop:x", "shop:y", "user:a", "user:b"] and sorted(r.node_id for r in nodes.values()) == list(range(5))
    assert nodes["extra"].luminance == 4.0 and nodes["user:a"].node_type == "user"
    assert graph.edges.count() == 7  # three rows both ways, repeated ones kept, and one that has both ends
    assert {r.bin for r in graph.edges.where(F.col("src") == nodes["user:a"].node_id).collect()} == {4}
    assert [(r.node_type, r.n) for r in graph.summary().collect()] == [("shop", 2), ("user", 2), ("odd", 1)]


def test_dense_ids(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    got = dense_ids(df.repartition(7), "k", name="n").collect()
    assert all(r.k == r.n for r in got) and len(got) == 5000
    assert dense_ids(df.limit(0), "k").count() == 0
