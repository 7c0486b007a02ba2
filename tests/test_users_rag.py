import pytest

from lightgraph.operators import rag, users, vectors
from lightgraph.operators.graph import Graph
from lightgraph.params import RagConfig, UserContext


def visits(spark, nodes, user=1):
    return spark.createDataFrame([(user, n, at) for at, n in enumerate(nodes)], "user_id long, node_id long, at long")


def test_history_and_session(spark):
    seen = users.history(visits(spark, [5, 5, 10]))
    session = users.sessions(seen)
    assert {r.node_id: r.times for r in seen.collect()} == {5: 2, 10: 1}
    assert [r.node_id for r in session.orderBy("pos").collect()] == [10, 5]
    rows = spark.createDataFrame([(1, 5), (1, 10), (1, 77)], "user_id long, node_id long")
    got = {r.node_id: r.boost for r in users.boosts(rows, seen, session).collect()}
    assert got == pytest.approx({5: 1.289861, 10: 1.269315, 77: 1.0}, abs=1e-6)
    c = users.context(1, seen, session)
    assert c.session == [10, 5] and c.interactions == {5: 2, 10: 1} and users.without_user(seen, 1).count() == 0


def test_sessions_keep_a_hundred(spark):
    s = users.sessions(users.history(visits(spark, list(range(150)))))
    assert s.count() == 100 and s.where("pos = 0").collect()[0].node_id == 149


def test_access(spark):
    rows = spark.createDataFrame([(1, 99, 7), (1, 1, 8), (2, 3, 9)], "user_id long, room int, node_id long")
    acl = spark.createDataFrame([(1, 1), (1, 2)], "user_id long, room int")
    assert sorted(r.node_id for r in users.accessible(rows, acl).collect()) == [8, 9]
    none = users.history(visits(spark, []))
    got = {r.node_id: r.boost for r in users.boosts(rows, none, users.sessions(none), acl).collect()}
    assert got == {7: 0.0, 8: 1.0, 9: 1.0}


def test_seeds(spark):
    seen = users.history(visits(spark, [1, 2, 3] + [100] * 10))
    got = [r.node_id for r in users.feed_seeds(seen, users.sessions(seen), 4).orderBy("rank").collect()]
    assert len(got) == 4 and got[:2] == [100, 3]


def test_affinities(spark):
    given = users.affinities(spark.createDataFrame([(1, 3, 7.0), (1, 4, -1.0), (1, 16, 0.5)], "user_id long, bin int, affinity double"))
    assert {(r.bin, r.affinity) for r in given.collect()} == {(3, 1.0), (4, 0.0)}
    best = users.preferred_bins(users.all_affinities(given, given)).orderBy("rank").collect()
    assert [r.bin for r in best] == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 4]


@pytest.fixture(scope="module")
def world(spark):
    nodes = spark.createDataFrame([(i, i % 2) for i in range(5)], "node_id long, room int")
    edges = spark.createDataFrame([(0, 1, 0, 0.1, 0), (1, 2, 0, 0.1, 1), (2, 3, 0, 0.1, 14), (0, 3, 1, 0.1, 10), (3, 4, 0, 0.1, 10)], "src long, dst long, pos int, attenuation double, bin int")
    vecs = [[1.0, 0.0, 0.0, 0.0], [0.9, 0.1, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.9, 0.1, 0.0], [0.0, 0.0, 1.0, 0.0]]
    return Graph.of(nodes, edges).materialized(), vectors.store(spark.createDataFrame(list(enumerate(vecs)), "node_id long, embedding array<double>"))


def test_query(world):
    graph, stored = world
    got = rag.query(graph, stored, "What is this?", [1.0, 0.0, 0.0, 0.0], config=RagConfig(top_k=3, include_paths=True)).collect()
    assert got[0].node_id in (0, 1) and got == sorted(got, key=lambda r: (-r.score, r.node_id)) and len(got) == 3
    assert all(r.reasoning_path and r.reasoning_path[-1] == r.node_id for r in got)
    assert rag.query(graph, stored, "x", [0.0] * 4).count() == 0
    user = UserContext("u", interactions={4: 5}, session=[4], rooms={0})
    assert {r.node_id for r in rag.query(graph, stored, "x", [1.0, 0.0, 0.0, 0.0], user).collect()} <= {0, 2, 4}


def test_feed(world):
    graph, _ = world
    assert rag.feed(graph, UserContext("u")).count() == 0
    got = rag.feed(graph, UserContext("u", interactions={0: 2}, session=[0]), RagConfig(top_k=2)).collect()
    assert got[0].node_id == 0 and got[0].personalization_boost > 1


def test_paths(world):
    graph, stored = world
    path = lambda *a: [r.path for r in rag.reasoning_path(graph, *a).collect()]
    assert path(0, 4, 4) == [[0, 3, 4]] and path(0, 2, 4) == [[0, 1, 2]] and path(0, 0, 0) == [[0]]
    assert path(0, 4, 1) == [] and path(4, 0, 4) == [] and path(9, 9, 2) == []
    assert [r.path for r in rag.reasoning_path_between(graph, stored, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], 4).collect()] == [[0, 3, 4]]
    assert {r.node_id: r.hops for r in rag.explore(graph, 0).collect()} == {1: 1, 3: 1, 2: 2, 4: 2}
    assert {r.node_id for r in rag.explore(graph, 0, [10]).collect()} == {3, 4}
    assert rag.classify("Why does this happen?") == "Causation"
