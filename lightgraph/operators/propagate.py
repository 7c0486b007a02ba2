"""Light propagation: bounded intensity that spreads along edges, weaker the more an edge turns from the way it came.

Many (qid, source, bin) run as one batch. Arcs are written once, in buckets of their source, so that a depth shuffles
its frontier but never the arcs; a node with very many arcs has them in shares, a bucket key each, and its frontier
rows go to all of them. A depth's transmissions are written to the shared folder. What all depths so far came to is one
row for each (qid, node, bin), its strongest and the sum, brought up to date by each depth. Three modes:

- ordered: every transmission counts; one that is stronger than all before it at its (node, bin), in visiting order,
  goes on. The order is an array of edge positions along the path, and "before" is a running maximum over it.
- maxbin: only the strongest at each (node, bin) counts, whenever it came. Order plays no part, so each depth is a plain
  maximum: the mode for very large frontiers.
- levelmax: every transmission counts; the strongest of each depth goes on, without memory of other depths.

The running maximum of mode ordered is a window as long as no (qid, node, bin) has more than HUB rows in a depth. Beyond
that it is a scan over stretches: rows are dealt out by ranges of (qid, node, bin, order), a task keeps those stronger
than all before them in its stretch, and the maxima of earlier stretches, a row each, decide among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import angular_distance, bit_at
from ..functions.lookups import LEAST_SIMILARITY, property_similarity
from ..params import MODES, LightParams, PropagationError
from ..session import bucketed, discard, forget, materialize
from .graph import Graph

SOURCES = "qid long, node_id long, bin int, weight double"
#: Arcs of a node in one share, arcs in a bucket, and rows of one (qid, node, bin) that a window takes.
SHARE, BUCKET, HUB = 1 << 16, 1 << 21, 1 << 20
#: Rows of depths that are read again before what they came to is written.
LAZY = 1 << 18
KEY = ("qid", "v", "bin")


def sources_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(qid, node_id, bin, weight); weight 1 where a row has three values."""
    return spark.createDataFrame([(*r, 1.0) if len(r) == 3 else r for r in rows], SOURCES)


def seeds(graph: Graph, sources: DataFrame, params: LightParams, mode: str) -> DataFrame:
    """(qid, u, bin, x, seq): what the sources emit. Unknown sources emit nothing."""
    at = sources.select("qid", "node_id", F.col("bin").alias("bin_in")).join(graph.nodes, "node_id")
    plain = F.greatest(F.col("luminance"), F.lit(1.0))
    if mode == "levelmax":
        mean = F.aggregate("dir_lum", F.lit(0.0), lambda a, x: a + x) / F.size("dir_lum")
        one = F.array(F.struct(F.col("bin_in").alias("bin"), F.greatest(mean, F.lit(1.0)).alias("x")))
        emitted = F.when(F.col("bin_in").between(0, params.bins - 1), one)
    elif mode == "maxbin":
        emitted = F.array(F.struct(F.pmod(F.col("bin_in"), F.lit(params.bins)).alias("bin"), plain.alias("x")))
    else:
        many = F.filter(F.transform("dir_lum", lambda x, i: F.struct(i.cast("int").alias("bin"), x.alias("x"))), lambda s: (s["x"] > params.min_intensity) & (s["bin"] < params.bins))
        one = F.array(F.struct(F.col("bin_in").alias("bin"), plain.alias("x")))
        emitted = F.when(F.col("prop").isNotNull(), many).otherwise(F.when(F.col("bin_in").between(0, params.bins - 1), one))
    return at.select("qid", F.col("node_id").alias("u"), F.explode(emitted).alias("s")).select("qid", "u", "s.bin", "s.x", F.array("s.bin").alias("seq"))


def arcs(graph: Graph, gate: bool, pvs: DataFrame | None) -> DataFrame:
    """Edges with what a step needs of both ends. Pairs of incompatible properties go here, once for all depths."""
    sender = graph.nodes.select(F.col("node_id").alias("src"), "reflection", "refraction", F.col("prop").alias("prop_u"), F.col("room").alias("room_u"))
    out = graph.edges.join(sender, "src")
    if gate or pvs is not None:
        out = out.join(graph.nodes.select(F.col("node_id").alias("dst"), F.col("prop").alias("prop_v"), F.col("room").alias("room_v")), "dst")
        if gate:
            out = out.where(F.coalesce(property_similarity(F.col("prop_u"), F.col("prop_v")), F.lit(1.0)) >= LEAST_SIMILARITY)
    keep = ["src", "dst", "pos", (F.col("reflection") * (F.lit(1.0) - F.col("attenuation"))).alias("factor"), "refraction", F.col("bin").alias("bin_out")]
    return out.select(*keep, *(["room_u", "room_v"] if pvs is not None else []))


def shares(edges: DataFrame, share: int = SHARE) -> tuple[DataFrame, DataFrame | None]:
    """Arcs in buckets of src, or of (src, share) and with (src, last_share) of the nodes that have several, if there are any; pos
    tells an arc's share."""
    many = not edges.where(F.col("pos") >= share).isEmpty()
    buckets = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // BUCKET))
    dealt = edges.withColumn("share", F.floor(F.col("pos") / share).cast("int")) if many else edges
    table = bucketed(dealt, "light-arcs", buckets, "src", *(["share"] if many else []))
    return table, materialize(table.where("share > 0").groupBy("src").agg(F.max("share").alias("last_share")), "light-hubs") if many else None


def seen_in(rows: DataFrame, bitmaps: DataFrame, from_room: str = "from_room", bin_: str = "bin", to_room: str = "to_room") -> DataFrame:
    """Rows whose room is seen, by rooms.visibility_bitmaps: one bitmap joins each, and one bit decides."""
    at = F.col(to_room).cast("long") + 1
    placed = rows.withColumns({"_bucket": F.bitmap_bucket_number(at), "_at": F.bitmap_bit_position(at)})
    maps = bitmaps.select(F.col("from_room").alias(from_room), F.col("bin").alias(bin_), F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    return placed.join(maps, [from_room, bin_, "_bucket"]).where(bit_at(F.col("_bits"), F.col("_at")) == 1).select(*rows.columns)


def transmissions(frontier: DataFrame, edges: DataFrame, hubs: DataFrame | None, pvs: DataFrame | None, params: LightParams, mode: str) -> DataFrame:
    """(qid, v, bin, x), and seq in mode ordered: what the frontier (qid, u, bin, x, seq) sends along the arcs."""
    sent = frontier.where(F.col("x") >= params.min_intensity).withColumnsRenamed({"bin": "bin_in", "u": "src"})
    if hubs is None:
        step = sent.join(edges, "src")
    else:
        step = sent.join(hubs, "src", "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("last_share", F.lit(0))))).join(edges, ["src", "share"])
    if pvs is not None and "bits" in pvs.columns:
        step = seen_in(step, pvs, "room_u", "bin_in", "room_v")
    elif pvs is not None:
        seen = pvs.select(F.col("from_room").alias("room_u"), F.col("bin").alias("bin_in"), F.col("to_room").alias("room_v"))
        step = step.join(seen, ["room_u", "bin_in", "room_v"], "left_semi")
    turn = angular_distance(F.col("bin_in"), F.col("bin_out"), params.bins) / F.lit(float(params.bins))
    x = F.col("x") * F.col("factor") * F.exp(F.lit(-float(params.k)) * F.col("refraction") * turn * turn)
    order = [F.concat("seq", F.array("pos")).alias("seq")] if mode == "ordered" else []
    cand = step.select("qid", F.col("dst").alias("v"), F.col("bin_out").alias("bin"), x.alias("x"), *order).where(F.col("x") >= params.min_intensity)
    return cand.groupBy(*KEY).agg(F.max("x").alias("x")) if mode == "maxbin" else cand


def records(cand: DataFrame) -> DataFrame:
    """Rows (qid, v, bin, x, seq) that are stronger than all before them in their (qid, v, bin), by a window."""
    earlier = F.max("x").over(Window.partitionBy(*KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return cand.withColumn("earlier", earlier).where(F.col("earlier").isNull() | (F.col("x") > F.col("earlier"))).drop("earlier")


def records_by_stretches(cand: DataFrame) -> DataFrame:
    """The same rows as records(), for groups of any size: none is gathered in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, most = None, -np.inf  # the group that the batch before ended in, and its maximum
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in KEY])
            x = batch.column("x").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))
            keep = np.zeros(len(x), bool)
            for a, b in zip(starts, np.append(starts[1:], len(x)), strict=True):
                group = tuple(keys[:, a].tolist())
                before = np.maximum.accumulate(np.append(most if group == last else -np.inf, x[a:b]))
                keep[a:b] = x[a:b] > before[:-1]
                last, most = group, before[-1]
            yield batch.filter(pa.array(keep))

    order = [*KEY, "seq"]
    ranged = cand.select(*KEY, "x", "seq").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("stretch", F.spark_partition_id())
    # A task's batches are its partition's rows in order, so `stretch` numbers the ranges.
    best = materialize(ranged.mapInArrow(work, ranged.schema), "light-records")
    tops = best.groupBy("stretch", *KEY).agg(F.max("x").alias("top"))
    before = F.max("top").over(Window.partitionBy(*KEY).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    earlier = tops.withColumn("earlier", before).where(F.col("earlier").isNotNull()).drop("top")
    return best.join(earlier, ["stretch", *KEY], "left").where(F.col("earlier").isNull() | (F.col("x") > F.col("earlier"))).select(*KEY, "x", "seq")


def propagate(
    graph: Graph, sources: DataFrame, params: LightParams = LightParams(), mode: str = "ordered", pvs: DataFrame | None = None,
    hub: int = HUB, share: int = SHARE, bucket: int = BUCKET, lazy: int = LAZY,
) -> DataFrame:
    """(qid, node_id, intensity) of all nodes that light reaches; a missing row is intensity 0.

    pvs (from_room, bin, to_room), or bitmaps of it, prunes edges into rooms that are not visible, in mode ordered only; it loses light
    that only a room's other nodes could pass on, so it is never used unasked. hub, share, bucket, lazy: rows of a (qid,
    node, bin) beyond which the running maximum is a scan over stretches, arcs of a node that go together, arcs beyond
    which they are kept in buckets, and rows beyond which each depth writes what all came to. None changes the result.
    """
    if mode not in MODES:
        raise PropagationError(f"mode {mode} is none of {MODES}")
    if params.bins < 1 or params.max_depth < 0:
        raise PropagationError("bins must be 1 or more and max_depth 0 or more")
    pvs = pvs if mode == "ordered" else None
    edges, hubs = arcs(graph, mode == "ordered", pvs), None
    if params.max_depth > 1:
        edges = materialize(edges, "light-edges")  # every depth reads them, so their joins and numbering run once
        if edges.count() > bucket:
            few, (edges, hubs) = edges, shares(edges, share)
            discard(few)
    frontier = materialize(seeds(graph, sources, params, mode), "light-0")
    state = frontier.select("qid", F.col("u").alias("v"), "bin", F.col("x").alias("best"), F.col("x").alias("total"))
    held, read, reread = [], [], 0  # tables behind the state, tables that only the frontier still reads, rows behind the state
    for depth in range(1, params.max_depth + 1):
        cand = materialize(transmissions(frontier, edges, hubs, pvs, params, mode), f"light-{depth}")
        discard(*read)
        rows, read = cand.count(), []  # from the files' footers
        if not rows:
            break
        held.append(cand)
        reread += rows
        came = cand.select(*KEY, F.col("x").alias("best"), F.col("x").alias("total"))
        after = state.unionByName(came)
        if depth < params.max_depth:
            frontier = ahead(cand, state, params, mode, rows > hub and largest(cand) > hub).withColumnRenamed("v", "u")
            if reread > lazy:
                after = materialize(summed(after, mode), f"light-state-{depth}")
                held, read, reread = [after], held, after.count()
        state = after
    if hubs is not None:
        discard(hubs)
    if hasattr(edges, "known_as"):
        forget(edges)
    return total_by_node(summed(state, mode).select("qid", F.col("v").alias("node_id"), "bin", F.col("total").alias("x")))


def summed(state: DataFrame, mode: str) -> DataFrame:
    """One row (qid, v, bin, best, total): the strongest, and the sum of all that came; in mode maxbin the strongest alone."""
    total = F.max("total") if mode == "maxbin" else F.sum("total")
    return state.groupBy(*KEY).agg(F.max("best").alias("best"), total.alias("total"))


def largest(cand: DataFrame) -> int:
    """Rows of the largest (qid, v, bin)."""
    return cand.groupBy(*KEY).count().agg(F.max("count")).collect()[0][0]


def ahead(cand: DataFrame, state: DataFrame, params: LightParams, mode: str, by_stretches: bool) -> DataFrame:
    """The rows of a depth that go on. state: (qid, v, bin, best) of the depths before it."""
    inside = cand.where(F.col("bin").between(0, params.bins - 1))
    if mode == "levelmax":
        return inside.groupBy(*KEY).agg(F.max("x").alias("x"))
    if mode == "ordered":
        inside = records_by_stretches(inside) if by_stretches else records(inside)
    best = state.groupBy(*KEY).agg(F.max("best").alias("best"))
    return inside.join(best, list(KEY), "left").where(F.col("best").isNull() | (F.col("x") > F.col("best"))).drop("best")


def total_by_node(states: DataFrame) -> DataFrame:
    """(qid, node_id, intensity): states (qid, node_id, bin, x) summed over directions."""
    return states.groupBy("qid", "node_id").agg(F.sum("x").alias("intensity"))
