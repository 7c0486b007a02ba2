"""Rooms: partitions of a graph, their portals, and which room sees which."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import byte_at
from ..params import BINS, LightParams, VisibilityError
from ..session import discard, materialize
from .graph import Graph, sum_before
from .propagate import propagate, seen_in  # noqa: F401  seen_in belongs to the bitmaps here

MOST_PVS_DEPTH = 10


def least_reaching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, root): the smallest id from which a node can be reached along edges (src, dst), itself included.

    Labels travel along edges and jump through their own labels, so long chains need few rounds; each round is written and
    the one before it deleted. Jumps go through distinct roots that moved themselves, few rows once labels settle, so a
    component whose nodes nearly all carry one root isn't gathered at that root.
    """
    written = labels = materialize(nodes.select("node_id", F.col("node_id").alias("root")), "reach")
    arcs = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "reach-edges")
    while True:
        offered = arcs.join(labels.withColumnRenamed("node_id", "src"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.min("root").alias("offer"))
        own = labels.select(F.col("node_id").alias("root"), F.col("root").alias("up")).where("up < root")
        up = own.join(labels.select("root").distinct(), "root", "left_semi")
        moved = labels.join(offered, "node_id", "left").join(up, "root", "left").select("node_id", F.least("root", "up", "offer").alias("to"), "root")
        moved = materialize(moved, "reach")
        if moved.where("to < root").isEmpty():
            discard(moved, arcs)
            return labels
        discard(written)
        written, labels = moved, moved.select("node_id", F.col("to").alias("root"))


def by_reach(graph: Graph) -> DataFrame:
    """(node_id, room): the reference's components, which follow edges in their direction only; rooms by ascending root."""
    roots = materialize(least_reaching(graph.nodes, graph.edges), "roots")
    numbers = _numbered(roots.select("root").distinct())
    return roots.join(numbers, "root").select("node_id", F.col("room").cast("int").alias("room"))


def _numbered(roots: DataFrame) -> DataFrame:
    from .graph import dense_ids

    return dense_ids(roots, "root", name="room")


def by_size(graph: Graph, size: int) -> DataFrame:
    """(node_id, room): breadth-first walks from ascending ids that stop at `size` nodes; what was queued but not reached
    shares one last room.

    The walk is sequential by nature. Weak components are walked apart, each in one task, and numbered by their walks'
    start nodes together.
    """
    size = max(1, size)
    both = graph.edges.select("src", "dst").unionByName(graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    weak = materialize(least_reaching(graph.nodes, both), "weak")
    rows = weak.join(graph.edges.groupBy(F.col("src").alias("node_id")).agg(F.sort_array(F.collect_list(F.struct("pos", "dst"))).alias("out")), "node_id", "left").select("root", "node_id", F.col("out.dst").alias("out"))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        out = {n: ([] if o is None else list(o)) for n, o in zip(part.node_id, part.out, strict=True)}
        seen, start_of = set(), {}
        for start in sorted(out):
            if start in seen:
                continue
            seen.add(start)
            queue, room = deque([start]), 0
            while queue:
                u = queue.popleft()
                start_of[u] = start
                room += 1
                if room >= size:
                    break
                for v in out[u]:
                    if v in out and v not in seen:
                        seen.add(v)
                        queue.append(v)
        return pd.DataFrame({"node_id": list(out), "start": [start_of.get(n) for n in out]}).astype({"start": "Int64"})

    walked = materialize(rows.groupBy("root").applyInPandas(walk, "node_id long, start long"), "walked")
    numbers = materialize(_numbered(walked.where("start is not null").select(F.col("start").alias("root")).distinct()), "rooms")
    last = F.broadcast(numbers.agg((F.coalesce(F.max("room"), F.lit(-1)) + 1).alias("last")))
    return walked.join(numbers, F.col("start") == F.col("root"), "left").crossJoin(last).select("node_id", F.coalesce("room", "last").cast("int").alias("room"))


def partition(graph: Graph, how: str = "components", size: int = 1) -> DataFrame:
    """(node_id, room): by `components`, `bfs` of a size, or `manual`, the rooms the nodes have."""
    if how == "components":
        return by_reach(graph)
    if how == "bfs":
        return by_size(graph, size)
    if how == "manual":
        return graph.nodes.select("node_id", "room")
    raise ValueError(f"no way to partition is called {how}")


def summary(graph: Graph) -> DataFrame:
    """(room, node_start, node_count), starts as if rooms lay one after the other."""
    counts = graph.nodes.groupBy("room").agg(F.count("*").alias("node_count"))
    return sum_before(counts, "room", "node_count", "node_start").select("room", "node_start", "node_count")


def room(graph: Graph, number: int) -> DataFrame:
    """One row (room, node_start, node_count), or none."""
    return summary(graph).where(F.col("room") == number)


def num_rooms(graph: Graph) -> int:
    return graph.nodes.select("room").distinct().count()


def portals(graph: Graph) -> DataFrame:
    """(src, dst, pos) of edges between rooms."""
    return mark_portals(graph).edges.where("is_portal").select("src", "dst", "pos")


def mark_portals(graph: Graph) -> Graph:
    rooms = graph.nodes.select("node_id", "room")
    joined = graph.edges.drop("is_portal").join(rooms.select(F.col("node_id").alias("src"), F.col("room").alias("_a")), "src").join(rooms.select(F.col("node_id").alias("dst"), F.col("room").alias("_b")), "dst")
    return Graph(graph.nodes, joined.select("src", "dst", "pos", "attenuation", "bin", (F.col("_a") != F.col("_b")).alias("is_portal")))


def representatives(graph: Graph) -> DataFrame:
    """(room, node_id): the smallest id with an edge out, else the smallest."""
    out = graph.edges.select(F.col("src").alias("node_id")).distinct().withColumn("out", F.lit(0))
    ranked = graph.nodes.select("node_id", "room").join(out, "node_id", "left")
    return ranked.groupBy("room").agg(F.min(F.struct(F.coalesce("out", F.lit(1)).alias("no_out"), "node_id")).alias("r")).select("room", "r.node_id")


def reachable_rooms(graph: Graph, sources: DataFrame, params: LightParams = LightParams()) -> DataFrame:
    """(qid, to_room): rooms with a node that light of the source reaches above the threshold, in 10 hops at most."""
    capped = LightParams(params.k, params.min_intensity, min(params.max_depth, MOST_PVS_DEPTH), params.bins)
    lit = propagate(graph, sources, capped).where(F.col("intensity") > params.min_intensity)
    return lit.join(graph.nodes.select("node_id", F.col("room").alias("to_room")), "node_id").select("qid", "to_room").distinct()


def compute_pvs(graph: Graph, params: LightParams = LightParams(), rooms: list[int] | None = None) -> DataFrame:
    """(from_room, bin, to_room), from one representative a room and all bins, as one batch. rooms: only from those."""
    starts = representatives(graph)
    if rooms is not None:
        starts = starts.where(F.col("room").isin(rooms))
    return _seen_from(graph, starts, params)


def _seen_from(graph: Graph, starts: DataFrame, params: LightParams) -> DataFrame:
    asked = starts.select("room", "node_id", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    asked = asked.withColumn("qid", F.col("room").cast("long") * BINS + F.col("bin")).withColumn("weight", F.lit(1.0))
    seen = reachable_rooms(graph, asked.select("qid", "node_id", "bin", "weight"), params)
    return seen.select(F.floor(F.col("qid") / BINS).cast("int").alias("from_room"), F.pmod("qid", F.lit(BINS)).cast("int").alias("bin"), "to_room")


def check_pvs(pvs: DataFrame, num_rooms: int) -> None:
    """Rooms and bins must be in range."""
    bad = pvs.where(~F.col("from_room").between(0, num_rooms - 1) | ~F.col("to_room").between(0, num_rooms - 1) | ~F.col("bin").between(0, BINS - 1)).limit(1).collect()
    if bad:
        raise VisibilityError(f"out of range: {bad[0].asDict()}")


def mark_visible(pvs: DataFrame, more: DataFrame) -> DataFrame:
    """Visibility with more triples (from_room, bin, to_room); marking twice changes nothing."""
    return pvs.unionByName(more).distinct()


def visible_rooms(pvs: DataFrame) -> DataFrame:
    """(from_room, bin, n, rooms) with the rooms in order."""
    return pvs.groupBy("from_room", "bin").agg(F.sort_array(F.collect_set("to_room")).alias("rooms")).withColumn("n", F.size("rooms"))


def is_visible(pvs: DataFrame, from_room: int, bin_: int, to_room: int) -> bool:
    return not pvs.where((F.col("from_room") == from_room) & (F.col("bin") == bin_) & (F.col("to_room") == to_room)).isEmpty()


def update_pvs(graph: Graph, pvs: DataFrame, room: int, params: LightParams = LightParams()) -> DataFrame:
    """Visibility with what one room sees now; nothing is removed."""
    return mark_visible(pvs, compute_pvs(graph, params, [room]))


def refresh_pvs(before: Graph, after: Graph, pvs: DataFrame, params: LightParams = LightParams()) -> tuple[DataFrame, DataFrame]:
    """(visibility of the graph `after`, the rooms (room) that were computed again), from that of `before`; both have the same nodes.

    Light takes an edge only if it reaches the edge's source a hop earlier at least. So from the sources of all edges that came, went or
    changed, a walk against the edges of both graphs, of max_depth - 1 hops, finds every representative whose light can differ. Rooms whose
    representative is another one are added. All their rows are replaced, so rooms that are no longer seen go too.
    """
    columns = ["src", "dst", "pos", "attenuation", "bin"]
    old, new = (g.edges.select(*columns) for g in (before, after))
    changed = materialize(old.exceptAll(new).unionByName(new.exceptAll(old)).select(F.col("src").alias("node_id")).distinct(), "pvs-changed")
    arcs, found = materialize(old.unionByName(new).select("src", "dst").distinct(), "pvs-arcs"), [changed]
    for _ in range(min(params.max_depth, MOST_PVS_DEPTH) - 1):
        step = arcs.join(found[-1].select(F.col("node_id").alias("dst")), "dst").select(F.col("src").alias("node_id")).distinct()
        for known in found:
            step = step.join(known, "node_id", "left_anti")
        found.append(materialize(step, "pvs-back"))
        if found[-1].isEmpty():
            break
    reach = found[0]
    for f in found[1:]:
        reach = reach.unionByName(f)
    was, starts = representatives(before), materialize(representatives(after), "pvs-starts")
    moved = starts.join(was.withColumnRenamed("node_id", "_was"), "room", "left").where(~F.col("node_id").eqNullSafe(F.col("_was"))).select("room")
    again = materialize(starts.join(reach, "node_id", "left_semi").select("room").unionByName(moved).distinct(), "pvs-rooms")
    kept = pvs.join(again.select(F.col("room").alias("from_room")), "from_room", "left_anti").select("from_room", "bin", "to_room")
    return kept.unionByName(_seen_from(after, starts.join(again, "room", "left_semi"), params)), again


# visibility as bitmaps


def visibility_bitmaps(pvs: DataFrame) -> DataFrame:
    """(from_room, bin, bucket, bits): a bit for each room seen. Bucket b has the rooms from 32,768 (b - 1) in 4,096 bytes, and only buckets
    with a room that is seen are rows: denser than triples from a few hundred rooms a bucket on."""
    at = F.col("to_room").cast("long") + 1  # buckets hold numbers from one
    return pvs.groupBy("from_room", "bin", F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def seen_by_any(bitmaps: DataFrame, *by: str) -> DataFrame:
    """(by, bucket, bits): the union of rooms seen, over all rows of a value of `by`; no room becomes a row."""
    return bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_rooms(bitmaps: DataFrame, *by: str) -> DataFrame:
    """(by, n, rooms): bitmaps as counts and lists of rooms in order, by (from_room, bin) unless others are named."""
    by = by or ("from_room", "bin")
    bits, start = F.col("bits"), (F.col("bucket") - 1) * 32768
    used = F.filter(F.sequence(F.lit(0), F.lit(4095)), lambda i: byte_at(bits, i) != 0)
    inside = lambda i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda j: F.getbit(byte_at(bits, i), j) == 1), lambda j: (start + i * 8 + j).cast("int"))
    parts = bitmaps.select(*by, F.bitmap_count("bits").alias("n"), F.flatten(F.transform(used, inside)).alias("rooms"))
    return parts.groupBy(*by).agg(F.sum("n").cast("int").alias("n"), F.array_sort(F.flatten(F.collect_list("rooms"))).alias("rooms"))
