"""Propagation against published and computed values, and against a walk in plain Python on random graphs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lightgraph.functions.columns import directional_luminance
from lightgraph.functions.lookups import similarity_of
from lightgraph.operators import influence
from lightgraph.operators.graph import Graph
from lightgraph.operators import propagate as light
from lightgraph.operators.propagate import propagate, sources_of
from lightgraph.params import LightParams, PropagationError
from lightgraph.plans.graphs import ring_graph


def graph_of(spark, nodes, edges):
    """nodes: (id, luminance, reflection, refraction); edges: (src, dst, attenuation, bin), in order."""
    n = spark.createDataFrame(nodes, "node_id long, luminance double, reflection double, refraction double")
    count: dict = {}
    rows = []
    for s, t, a, b in edges:
        rows.append((s, t, count.setdefault(s, 0), a, b))
        count[s] += 1
    return Graph.of(n, spark.createDataFrame(rows, "src long, dst long, pos int, attenuation double, bin int"))


def lit(graph, source, bin_, params=LightParams(), mode="ordered", pvs=None):
    return {r.node_id: r.intensity for r in propagate(graph, sources_of(graph.nodes.sparkSession, [(0, source, bin_)]), params, mode, pvs).collect()}


CHAIN = [(0, 2.0, 1.0, 1.0), (1, 0.5, 1.0, 1.0), (2, 0.0, 1.0, 1.0)]


def test_chain(spark):
    got = lit(graph_of(spark, CHAIN, [(0, 1, 0.1, 2), (1, 2, 0.2, 2)]), 0, 2)
    assert got == pytest.approx({0: 2, 1: 1.8, 2: 1.44}, abs=1e-6)
    got = lit(graph_of(spark, CHAIN, [(0, 1, 0.1, 2), (1, 2, 0.2, 8)]), 0, 2)
    assert got == pytest.approx({0: 2, 1: 1.8, 2: 0.712852}, abs=1e-6)
    nodes = [(0, 2.0, 0.9, 1.0), (1, 0.5, 0.8, 2.0), (2, 0.0, 0.5, 1.5)]
    assert lit(graph_of(spark, nodes, [(0, 1, 0.1, 2), (1, 2, 0.2, 2)]), 0, 2) == pytest.approx({0: 2, 1: 1.62, 2: 1.0368}, abs=1e-6)


def test_diamond(spark):
    nodes = [(i, 1.0, 0.9, 1.5) for i in range(4)]
    got = lit(graph_of(spark, nodes, [(0, 1, 0.1, 2), (0, 2, 0.2, 4), (1, 3, 0.15, 2), (2, 3, 0.1, 8)]), 0, 2)
    assert got == pytest.approx({0: 1, 1: 0.81, 2: 0.640381, 3: 0.94425}, abs=1e-5)


def test_rings(spark):
    five = ring_graph(spark, 1000, 5, 0.1, 0.05).materialized()
    got = lit(five, 0, 2)
    assert len(got) == 21 and max(got.values()) == pytest.approx(7.797689, abs=1e-5) and sum(got.values()) == pytest.approx(89.552571, abs=1e-5)
    assert sum(lit(five, 0, 2, mode="maxbin").values()) == pytest.approx(14.970235, abs=1e-5)
    eight = ring_graph(spark).materialized()
    got = lit(eight, 0, 2)
    assert len(got) == 33 and max(got.values()) == pytest.approx(18.597227, abs=1e-5) and sum(got.values()) == pytest.approx(253.242725, abs=1e-4)


def test_directional_ring_matches_published_maxima(spark):
    ring = ring_graph(spark)
    nodes = ring.nodes.withColumn("prop", F.lit("IsA")).withColumn("dir_lum", directional_luminance(F.lit("IsA"), F.lit(2.0), F.lit(0.8)))
    graph = Graph(nodes, ring.edges).materialized()
    got = lit(graph, 0, 2)
    assert got[0] == pytest.approx(25.6, abs=1e-6) and max(got.values()) == pytest.approx(31.29731, abs=1e-4)
    assert max(lit(graph, 0, 2, mode="levelmax").values()) == pytest.approx(12.241932, abs=1e-4)


def walk(nodes, edges, props, source, bin_, p, mode):
    """Sequential model: visits states in order, edges in order."""
    out: dict = {}
    for s, t, a, b in edges:
        out.setdefault(s, []).append((t, a, b))
    table, total = {}, {}
    if mode == "ordered" and props.get(source):
        frontier = [(source, b, x) for b, x in enumerate(props[source][1]) if x > p.min_intensity]
    else:
        frontier = [(source, bin_, max(nodes[source][1], 1.0))]
    for u, b, x in frontier:
        table[u, b] = x
        total[u] = total.get(u, 0) + x
    for _ in range(p.max_depth):
        nxt, level = [], {}
        for u, b, x in frontier:
            if x < p.min_intensity:
                continue
            for v, a, bo in out.get(u, []):
                if mode == "ordered" and props.get(u) and props.get(v) and similarity_of(props[u][0], props[v][0]) < 0.2:
                    continue
                d = min(abs(b - bo), 16 - abs(b - bo)) / 16
                t = x * (nodes[u][2] * (1 - a)) * math.exp(-p.k * nodes[u][3] * d * d)
                if t < p.min_intensity:
                    continue
                total[v] = total.get(v, 0) + t
                if mode == "levelmax":
                    level[v, bo] = max(level.get((v, bo), 0), t)
                elif t > table.get((v, bo), 0):
                    table[v, bo] = t
                    nxt.append((v, bo, t))
        frontier = [(v, b, x) for (v, b), x in level.items()] if mode == "levelmax" else nxt
    if mode == "maxbin":
        total = {}
        for (v, _), x in table.items():
            total[v] = total.get(v, 0) + x
    return total


@pytest.mark.parametrize("mode", ["ordered", "maxbin"])
def test_random_graphs(spark, mode):
    rng = random.Random(7)
    for _ in range(4):
        n = rng.randint(4, 14)
        nodes = [(i, rng.choice([0.5, 1.0, 2.0]), rng.uniform(0.7, 1), rng.uniform(0.5, 2)) for i in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 0.4), rng.randrange(16)) for _ in range(3 * n)]
        props = {i: (p, [rng.uniform(0, 2) for _ in range(16)]) for i in range(n) if (p := rng.choice([None, "IsA", "OppositeOf", "Causes"]))} if mode == "ordered" else {}
        graph = graph_of(spark, nodes, edges)
        if props:
            over = spark.createDataFrame([(i, p, d) for i, (p, d) in props.items()], "node_id long, prop string, dir_lum array<double>")
            graph = graph.with_nodes(over)
        sources = [(q, rng.randrange(n), rng.randrange(16)) for q in range(3)]
        got: dict = {}
        for r in propagate(graph.materialized(), sources_of(spark, sources), LightParams(max_depth=3), mode).collect():
            got.setdefault(r.qid, {})[r.node_id] = r.intensity
        for q, s, b in sources:
            assert got.get(q, {}) == pytest.approx(walk(nodes, edges, props, s, b, LightParams(max_depth=3), mode), abs=1e-9)


def test_edges_of_the_parameter_space(spark):
    graph = graph_of(spark, CHAIN, [(0, 1, 0.1, 2), (1, 2, 0.2, 2)])
    assert lit(graph, 99, 2) == {} and lit(graph, 0, 16) == {}
    assert lit(graph, 0, 2, LightParams(max_depth=0)) == {0: 2.0}
    assert lit(graph, 0, 18, mode="maxbin") == lit(graph, 0, 2, mode="maxbin")
    nothing = spark.createDataFrame([], "from_room int, bin int, to_room int")
    assert lit(graph, 0, 2, pvs=nothing) == {0: 2.0}
    with pytest.raises(PropagationError):
        propagate(graph, sources_of(spark, [(0, 0, 0)]), mode="none")
    top = influence.top_k(graph, 0, 2, 2).collect()
    assert [r.node_id for r in top] == [0, 1] and top[0].distance == pytest.approx(-0.693148, abs=1e-6)
    assert influence.distance(graph, 0, 7, 2).collect()[0].distance is None
    assert influence.distance_or_infinity(graph, 2, 0).collect()[0].distance == math.inf


@pytest.mark.parametrize("mode", ["ordered", "maxbin", "levelmax"])
def test_buckets_shares_and_stretches_change_nothing(spark, mode):
    """Arcs in buckets and shares of two, every depth's sums written, the running maximum over stretches: the rows of the plain way."""
    rng = random.Random(11)
    nodes = [(i, 2.0, 0.95, 1.0) for i in range(14)]
    graph = graph_of(spark, nodes, [(rng.randrange(14), rng.randrange(14), rng.random() / 4, rng.randrange(16)) for _ in range(70)]).materialized()
    sources = sources_of(spark, [(q, q % 14, q % 16) for q in range(9)])
    rows = lambda **how: {(r.qid, r.node_id): r.intensity for r in propagate(graph, sources, LightParams(max_depth=3), mode, **how).collect()}
    assert rows(hub=0, share=2, bucket=0, lazy=0) == pytest.approx(rows(), abs=1e-9)


def test_arcs_are_not_shuffled(spark):
    """The plan of a depth has one exchange, that of the frontier; the arcs' side reads buckets."""
    graph = ring_graph(spark, 500).materialized()
    edges, hubs = light.shares(light.arcs(graph, True, None))
    assert hubs is None
    frontier = light.seeds(graph, sources_of(spark, [(q, q, 2) for q in range(300)]), LightParams(), "ordered")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from lightgraph.session import forget, materialize

        step = light.transmissions(materialize(frontier, "front"), edges, hubs, None, LightParams(), "ordered")
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert step.count() == 300 * 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1 and "SortMergeJoin" in plan
    forget(edges)
    assert not [t for t in spark.catalog.listTables() if t.name == edges.known_as]


def test_a_hub_is_many_tasks(spark):
    """A star of 100,000 arcs into one node: its running maximum is dealt out by ranges of the order, and equals the window's."""
    n = 100_000
    star = spark.range(n).select(F.lit(0).cast("long").alias("qid"), F.lit(7).cast("long").alias("v"), F.lit(3).alias("bin"), (F.xxhash64("id") % 1_000_003).cast("double").alias("x"), F.array(F.lit(2), F.col("id").cast("int")).alias("seq"))
    other = spark.range(500).select((F.col("id") % 5).alias("qid"), (F.col("id") % 3).alias("v"), (F.col("id") % 2).cast("int").alias("bin"), (F.xxhash64("id") % 97).cast("double").alias("x"), F.array(F.lit(1), F.col("id").cast("int")).alias("seq"))
    cand = star.unionByName(other)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        order = [*light.KEY, "seq"]
        tasks = cand.repartitionByRange(*order).where("v = 7").groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) >= 12 and max(r["count"] for r in tasks) < n // 5
        got = sorted(map(tuple, light.records_by_stretches(cand).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(map(tuple, light.records(cand).select(*light.KEY, "x", "seq").collect()))


def test_a_node_with_many_arcs_in_shares(spark):
    """A star of 20,000 arcs out of one node and back into another, in shares of 1,000."""
    n = 20_000
    nodes = spark.range(n + 2).select(F.col("id").alias("node_id"), F.lit(2.0).alias("luminance"), F.lit(0.9).alias("reflection"))
    out = spark.range(n).select(F.lit(n).cast("long").alias("src"), F.col("id").alias("dst"), F.col("id").cast("int").alias("pos"), F.lit(0.1).alias("attenuation"), F.lit(2).alias("bin"))
    back = spark.range(n).select(F.col("id").alias("src"), F.lit(n + 1).cast("long").alias("dst"), F.lit(0).alias("pos"), F.lit(0.1).alias("attenuation"), F.lit(2).alias("bin"))
    graph = Graph.of(nodes, out.unionByName(back))
    edges, hubs = light.shares(light.arcs(graph, True, None), 1000)
    assert [tuple(r) for r in hubs.collect()] == [(n, 19)]
    got = {r.node_id: r.intensity for r in propagate(graph, sources_of(spark, [(0, n, 2)]), LightParams(max_depth=2), share=1000, bucket=0, hub=100).collect()}
    assert len(got) == n + 2 and got[n + 1] == pytest.approx(n * 2 * 0.81 * 0.81, rel=1e-9)
