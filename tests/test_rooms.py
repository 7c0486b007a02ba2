"""Rooms, portals, visibility, against walks in plain Python."""

import random
from collections import deque

import pytest

from lightgraph.operators import rooms
from lightgraph.operators.graph import Graph
from lightgraph.operators.propagate import propagate, sources_of
from lightgraph.params import LightParams, VisibilityError


def graph_of(spark, n, pairs, room=None):
    nodes = spark.createDataFrame([(i, (room or [0] * n)[i]) for i in range(n)], "node_id long, room int")
    at: dict = {}
    rows = []
    for s, t in pairs:
        rows.append((s, t, at.setdefault(s, 0)))
        at[s] += 1
    return Graph.of(nodes, spark.createDataFrame(rows, "src long, dst long, pos int"))


def room_list(df):
    return [r.room for r in df.orderBy("node_id").collect()]


def test_components_follow_direction(spark):
    got = room_list(rooms.partition(graph_of(spark, 4, [(0, 1), (1, 0), (2, 3), (3, 2)])))
    assert got[0] == got[1] != got[2] == got[3]
    assert room_list(rooms.partition(graph_of(spark, 3, [(2, 1), (1, 0)]))) == [0, 1, 2]


def test_components_on_random_graphs(spark):
    rng = random.Random(3)
    for _ in range(3):
        n = rng.randint(5, 25)
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
        room: dict = {}
        for s in range(n):
            if s not in room:
                k, todo = len(set(room.values())), [s]
                while todo:
                    u = todo.pop()
                    if u not in room:
                        room[u] = k
                        todo += [b for a, b in pairs if a == u]
        assert room_list(rooms.partition(graph_of(spark, n, pairs))) == [room[i] for i in range(n)]


def bfs(n, pairs, size):
    room, seen, k = [None] * n, set(), 0
    for s in range(n):
        if s in seen:
            continue
        seen.add(s)
        queue, count = deque([s]), 0
        while queue:
            u = queue.popleft()
            room[u] = k
            count += 1
            if count >= size:
                break
            for a, b in pairs:
                if a == u and b not in seen:
                    seen.add(b)
                    queue.append(b)
        k += 1
    return [k if r is None else r for r in room]


def test_bfs_partition(spark):
    assert room_list(rooms.partition(graph_of(spark, 6, [(i, i + 1) for i in range(5)]), "bfs", 2)) == [0, 0, 1, 1, 2, 2]
    assert room_list(rooms.partition(graph_of(spark, 6, [(0, 1), (0, 2), (0, 3), (3, 4), (4, 5)]), "bfs", 2)) == [0, 0, 2, 2, 1, 1]
    rng = random.Random(5)
    n = 20
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(22)]
    assert room_list(rooms.partition(graph_of(spark, n, pairs), "bfs", 3)) == bfs(n, pairs, 3)


def test_manual_and_unknown(spark):
    graph = graph_of(spark, 3, [(0, 1)], [4, 4, 5])
    assert room_list(rooms.partition(graph, "manual")) == [4, 4, 5]
    with pytest.raises(ValueError):
        rooms.partition(graph, "none")


def test_portals_and_summary(spark):
    graph = graph_of(spark, 4, [(0, 1), (1, 2), (2, 3)], [0, 0, 1, 1])
    assert [(r.src, r.dst) for r in rooms.portals(graph).collect()] == [(1, 2)]
    assert [tuple(r) for r in rooms.summary(graph).orderBy("room").collect()] == [(0, 0, 2), (1, 2, 2)]


def test_visibility_loses_what_a_representative_does_not_see(spark):
    graph = graph_of(spark, 3, [(0, 0), (1, 2)], [0, 0, 1])
    pvs = rooms.compute_pvs(graph, LightParams(max_depth=2))
    assert {(r.from_room, r.to_room) for r in pvs.collect()} == {(0, 0), (1, 1)}
    free = propagate(graph, sources_of(spark, [(0, 1, 0)])).collect()
    cut = propagate(graph, sources_of(spark, [(0, 1, 0)]), pvs=pvs).collect()
    assert {r.node_id for r in free} == {1, 2} and {r.node_id for r in cut} == {1}
    assert {(r.from_room, r.to_room) for r in rooms.update_pvs(graph, pvs.where("from_room = 1"), 0, LightParams(max_depth=2)).collect()} == {(0, 0), (1, 1)}


def test_marks(spark):
    schema = "from_room int, bin int, to_room int"
    pvs = rooms.mark_visible(spark.createDataFrame([(0, 2, 1)], schema), spark.createDataFrame([(0, 2, 1), (0, 2, 2)], schema))
    assert rooms.is_visible(pvs, 0, 2, 1) and rooms.is_visible(pvs, 0, 2, 2)
    assert not rooms.is_visible(pvs, 0, 2, 0) and not rooms.is_visible(pvs, 1, 2, 1)
    rooms.check_pvs(pvs, 3)
    with pytest.raises(VisibilityError):
        rooms.check_pvs(pvs, 2)


def test_visibility_bitmaps(spark):
    """Lookups, unions and lists of bitmaps over several buckets, against sets."""
    rng = random.Random(7)
    seen = {(f, b, t) for f in range(3) for b in (0, 5) for t in rng.sample([0, 1, 7, 8, 32766, 32767, 32768, 32769, 70000, 98303, 98304], 6)}
    pvs = spark.createDataFrame(sorted(seen) * 2, "from_room int, bin int, to_room int")
    maps = rooms.visibility_bitmaps(pvs)
    assert {(r.bucket, len(r.bits)) for r in maps.collect()} <= {(b, 4096) for b in range(1, 5)}
    asked = [(f, b, t, i) for i, (f, b, t) in enumerate((f, b, t) for f in range(4) for b in (0, 5, 6) for t in (0, 1, 2, 7, 8, 9, 32766, 32767, 32768, 32769, 32770, 70000, 98303, 98304, 500000))]
    got = rooms.seen_in(spark.createDataFrame(asked, "from_room int, bin int, to_room int, at int"), maps).collect()
    assert sorted(tuple(r) for r in got) == [r for r in asked if r[:3] in seen]
    lists = {(r.from_room, r.bin): (r.n, r.rooms) for r in rooms.bitmap_rooms(maps).collect()}
    assert lists == {(f, b): (6, sorted(t for x, y, t in seen if (x, y) == (f, b))) for f in range(3) for b in (0, 5)}
    union = {r.bin: r.rooms for r in rooms.bitmap_rooms(rooms.seen_by_any(maps, "bin"), "bin").collect()}
    assert union == {b: sorted({t for _, y, t in seen if y == b}) for b in (0, 5)}
    assert rooms.bitmap_rooms(rooms.visibility_bitmaps(pvs.limit(0))).count() == 0


@pytest.mark.parametrize("form", ["triples", "bitmaps"])
def test_light_is_pruned_by_either_form(spark, form):
    g = graph_of(spark, 4, [(0, 1), (0, 2), (1, 3), (2, 3)], [0, 1, 2, 3])
    pvs = spark.createDataFrame([(0, b, 1) for b in range(16)] + [(1, b, 3) for b in range(16)], "from_room int, bin int, to_room int")
    lit = propagate(g, sources_of(spark, [(0, 0, 2)]), LightParams(), pvs=pvs if form == "triples" else rooms.visibility_bitmaps(pvs)).collect()
    assert {r.node_id for r in lit} == {0, 1, 3}


@pytest.mark.parametrize("seed", [1, 2])
def test_refreshed_visibility_equals_a_full_one(spark, seed):
    """Edges come, go and change at random; a chain of rooms shows that those far from the change stay."""
    rng, n, params = random.Random(seed), 24, LightParams(max_depth=2)
    pairs = [(i, i + 1) for i in range(n - 1)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(3)]
    room = [i // 2 for i in range(n)]
    before = graph_of(spark, n, pairs, room).materialized()
    other = [p for i, p in enumerate(pairs) if i != 20] + [(rng.randrange(18, n), rng.randrange(n))]
    after = graph_of(spark, n, other, room).materialized()
    pvs = rooms.compute_pvs(before, params)
    got, again = rooms.refresh_pvs(before, after, pvs, params)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rooms.compute_pvs(after, params).collect()))
    assert 0 < again.count() < n // 2
    same, none = rooms.refresh_pvs(before, before, pvs, params)
    assert none.count() == 0 and same.count() == pvs.count()
