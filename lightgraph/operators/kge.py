"""Knowledge-graph embeddings: rotation scores, losses, evaluation, a graph encoder, and training.

Scores and losses are column expressions. Vectors hold a real and an imaginary half; a relation's direction bin rotates
them by a phase for each component.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cosine, dot
from ..params import BINS, TrainConfig
from ..session import materialize
from .vectors import matrix

Phases = list[list[float]]


def initial_entities(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """(node_id, embedding) uniform within 1 / sqrt(dim); each value comes from the seed, the id and its place."""
    scale = 1.0 / math.sqrt(dim)
    value = lambda j: (F.pmod(F.xxhash64("id", j, F.lit(seed)), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40)) * 2 - 1) * scale
    return spark.range(n).select(F.col("id").alias("node_id"), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value).alias("embedding"))


def initial_phases(dim: int, seed: int = 42) -> Phases:
    """A phase for each bin and component, normal with deviation 0.1."""
    return (0.1 * np.random.default_rng(seed).standard_normal((BINS, dim // 2))).tolist()


def phase_column(phases: Phases, bin_: Column) -> Column:
    return F.element_at(F.array(*(F.array(*map(F.lit, p)) for p in phases)), bin_ + 1)


def rotate(v: Column, phi: Column) -> Column:
    """The vector rotated component by component."""
    half = (F.size(v) / 2).cast("int")
    re, im = F.slice(v, 1, half), F.slice(v, half + 1, half)
    both = F.zip_with(F.zip_with(re, im, lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))), phi, lambda s, p: F.struct(
        (s["a"] * F.cos(p) - s["b"] * F.sin(p)).alias("a"), (s["a"] * F.sin(p) + s["b"] * F.cos(p)).alias("b")))
    return F.concat(F.transform(both, lambda s: s["a"]), F.transform(both, lambda s: s["b"]))


def rotation_distance(head: Column, tail: Column, phi: Column) -> Column:
    """Sum over components of sqrt(re^2 + im^2 + 1e-8) of the rotated head less the tail; lower is better."""
    gap = F.zip_with(rotate(head, phi), tail, lambda a, b: a - b.cast("double"))
    half = (F.size(gap) / 2).cast("int")
    parts = F.zip_with(F.slice(gap, 1, half), F.slice(gap, half + 1, half), lambda a, b: F.sqrt(a * a + b * b + 1e-8))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def scored(triples: DataFrame, embeddings: DataFrame, phases: Phases) -> DataFrame:
    """Triples (head_id, angle_bin, tail_id) with their distance."""
    h = embeddings.select(F.col("node_id").alias("head_id"), F.col("embedding").alias("_h"))
    t = embeddings.select(F.col("node_id").alias("tail_id"), F.col("embedding").alias("_t"))
    joined = triples.join(h, "head_id").join(t, "tail_id")
    return joined.withColumn("distance", rotation_distance(F.col("_h"), F.col("_t"), phase_column(phases, F.col("angle_bin")))).drop("_h", "_t")


def margin_loss(positive: Column, negative: Column, margin: float = 1.0) -> Column:
    return F.avg(F.greatest(F.lit(0.0), F.lit(margin) + positive - negative))


def log_sigmoid(x: Column) -> Column:
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def rotation_loss(positive: Column, negatives: Column, gamma: float = 12.0) -> Column:
    """-(log sigmoid(gamma - positive) + mean log sigmoid(-(gamma - negative))) of one row; negatives is an array."""
    far = F.aggregate(negatives, F.lit(0.0), lambda s, x: s + log_sigmoid(x - gamma)) / F.size(negatives)
    return -(log_sigmoid(F.lit(gamma) - positive) + far)


def triplet_loss(anchor: Column, positive: Column, negative: Column, margin: float = 0.5, kind: str = "cosine") -> Column:
    """max(0, d(a, p) - d(a, n) + margin) of one row."""
    if kind == "cosine":
        d = lambda a, b: F.lit(1.0) - cosine(a, b)
    else:
        d = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x.cast("double")))
    return F.greatest(F.lit(0.0), d(anchor, positive) - d(anchor, negative) + F.lit(margin))


def log_sum_exp(values: Column) -> Column:
    most = F.array_max(values)
    return most + F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - most)))


def info_nce(anchor: Column, positive: Column, negatives: Column, temperature: float = 0.07) -> Column:
    """Cross entropy of one row: the positive by cosine, negatives (array of vectors) by inner product, over a temperature."""
    p = cosine(anchor, positive) / F.lit(temperature)
    n = F.transform(negatives, lambda v: dot(anchor, v) / F.lit(temperature))
    return log_sum_exp(F.concat(F.array(p), n)) - p


def in_batch_loss(batch: DataFrame, scale: float = 20.0) -> DataFrame:
    """(loss): mean cross entropy of each query's cosine to its own document among those of its batch.

    batch: (batch, id, query, document). Batches are the unit of the loss and as small as they are made.
    """
    q = batch.select("batch", "id", "query")
    d = batch.select("batch", F.col("id").alias("other"), "document")
    logits = q.join(d, "batch").select("batch", "id", "other", (cosine(F.col("query"), F.col("document")) * scale).alias("x"))
    rows = logits.groupBy("batch", "id").agg(F.sort_array(F.collect_list("x")).alias("all"), F.max(F.when(F.col("id") == F.col("other"), F.col("x"))).alias("own"))
    return rows.agg(F.avg(log_sum_exp(F.col("all")) - F.col("own")).alias("loss"))


def combined_loss(parts: list[tuple[float, Column]]) -> Column:
    out = F.lit(0.0)
    for weight, loss in parts:
        out = out + F.lit(float(weight)) * loss
    return out


#: Entities that the space is cut by at most, rows of one block of a cell, and values of one step of a comparison.
PIVOTS, CELL, STEP = 64, 4096, 1 << 22
#: Triples of a block, those of them that are compared at once, and the columns of a block, bytes of arrays.
TRIPLES, ROWS = 2048, 128
BLOCKS = ("head", "bin", "tail", "own", "sure", "open", "turned")


def plain_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums over components of the gaps' lengths, each row of x with each of y: a metric, as every component's length is one."""
    half, out = x.shape[1] // 2, np.empty((len(x), len(y)))
    rows = max(1, STEP // max(1, y.size))
    for i in range(0, len(x), rows):
        out[i : i + rows] = np.hypot(x[i : i + rows, None, :half] - y[None, :, :half], x[i : i + rows, None, half:] - y[None, :, half:]).sum(2)
    return out


def cells(embeddings: DataFrame, pivots: int) -> tuple[DataFrame, np.ndarray]:
    """Entities (node_id, embedding, cell, away) with their nearest pivot and its distance, written; and the pivots, drawn by a hash of the id."""
    drawn = embeddings.select("node_id", "embedding").orderBy(F.xxhash64("node_id", F.lit(1)), "node_id").limit(pivots).toArrow()  # `pivots` rows
    points = matrix(drawn.column("embedding")) if drawn.num_rows else np.empty((0, 0))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = plain_distance(matrix(pa.chunked_array([batch.column("embedding")])), points)
                cell = d.argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(d[np.arange(len(d)), cell])], names=["node_id", "embedding", "cell", "away"])

    rows = embeddings.select("node_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return materialize(rows.mapInArrow(make, "node_id long, embedding array<double>, cell int, away double"), "links-cells"), points


def bounds(entities: DataFrame, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cell: the least and the largest distance of its entities to each pivot, and how many it has. A row for each cell and task meets here."""
    n = len(points)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, count = np.full((n, n), np.inf), np.full((n, n), -np.inf), np.zeros(n, np.int64)
        for batch in batches:
            d, cell = plain_distance(matrix(pa.chunked_array([batch.column("embedding")])), points), batch.column("cell").to_numpy()
            np.minimum.at(low, cell, d)
            np.maximum.at(high, cell, d)
            count += np.bincount(cell, minlength=n)
        for c in np.flatnonzero(count):
            yield pa.RecordBatch.from_pylist([{"cell": int(c), "pivot": p, "low": low[c, p], "high": high[c, p], "n": int(count[c])} for p in range(n)], pa.schema([("cell", pa.int32()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int64())]))

    parts = entities.mapInArrow(ranges, "cell int, pivot int, low double, high double, n long").groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    low, high, count = np.full((n, n), np.inf), np.full((n, n), -np.inf), np.zeros(n, np.int64)
    for r in parts.toArrow().to_pylist():  # PIVOTS squared at most
        low[r["cell"], r["pivot"]], high[r["cell"], r["pivot"]], count[r["cell"]] = r["low"], r["high"], r["n"]
    return low, high, count


def grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows, from batches in their order."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held, n = [*held, batch], n + batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def packed_cells(entities: DataFrame) -> DataFrame:
    """Blocks of entities of one cell, at like distances from its pivot, written: (cell, nodes, vectors, off), off in ascending order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 2 * CELL):
            cell, off = t.column("cell").to_numpy(), t.column("away").to_numpy()
            node, x = t.column("node_id").to_numpy(), matrix(t.column("embedding"))
            for c in np.unique(cell):
                at = np.flatnonzero(cell == c)
                at = at[np.argsort(off[at], kind="stable")]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), *(pa.array([v[at].tobytes()], pa.binary()) for v in (node.astype(np.int64), x, off))], names=["cell", "nodes", "vectors", "off"])

    ordered = entities.repartitionByRange(max(1, -(-entities.count() // CELL)), "cell", "away", "node_id").sortWithinPartitions("cell", "away")
    return materialize(ordered.mapInArrow(pack, "cell int, nodes binary, vectors binary, off binary"), "links-blocks")


def single_columns(y: np.ndarray) -> np.ndarray:
    """(components, 4, rows): a component and its squared length, as nearer_rows() multiplies them in single precision."""
    half = y.shape[1] // 2
    squares = y[:, :half] ** 2 + y[:, half:] ** 2
    with np.errstate(over="ignore"):  # nearer_rows() doesn't use them then
        return np.ascontiguousarray(np.stack([y[:, :half], y[:, half:], np.ones_like(squares), squares + 1e-8]).transpose(2, 0, 1).astype(np.float32))


def nearer_rows(x: np.ndarray, own: np.ndarray, tail: np.ndarray, y: np.ndarray, node: np.ndarray, right: np.ndarray, longest: float) -> np.ndarray:
    """For each row of x: the rows of y, its tail aside, whose distance is below its own.

    A component's squared length comes from a product in single precision; its error is below 16 x 2^-24 (|x| + |y|)^2, so that of the
    sum of roots is below the root of that factor times the sums of lengths. What this leaves open is computed in double precision.
    """
    half = x.shape[1] // 2
    xs = x[:, :half] ** 2 + x[:, half:] ** 2
    slack = np.sqrt(16 * 2.0**-24) * (np.sqrt(xs).sum(1) + longest) + (half + 8) * 2.0**-22 * (1 + own)
    if max(np.sqrt(xs).sum(1).max(), longest) < 1e15:
        left = np.ascontiguousarray(np.stack([-2 * x[:, :half], -2 * x[:, half:], xs, np.ones_like(xs)], 2).transpose(1, 0, 2).astype(np.float32))
        total, one = np.zeros((len(x), len(y)), np.float32), np.empty((len(x), len(y)), np.float32)
        with np.errstate(invalid="ignore"):  # rounded below zero: no number, which leaves the pair open
            for c in range(half):
                np.matmul(left[c], right[c], out=one)
                total += np.sqrt(one, out=one)
        sure = total < (own - slack).astype(np.float32)[:, None]
        open_ = ~(sure | (total > (own + slack).astype(np.float32)[:, None]))
    else:
        sure, open_ = np.zeros((len(x), len(y)), bool), np.ones((len(x), len(y)), bool)
    for i in np.flatnonzero(np.isin(tail, node)):
        sure[i, node == tail[i]] = False
    n = sure.sum(1)
    i, j = np.nonzero(open_)
    for k in range(0, len(i), STEP // 64):
        a, b = i[k : k + STEP // 64], j[k : k + STEP // 64]
        gap = x[a] - y[b]
        d = np.sqrt(gap[:, :half] ** 2 + gap[:, half:] ** 2 + 1e-8).sum(1)
        n += np.bincount(a[(d < own[a] - 1e-12) & (node[b] != tail[a])], minlength=len(x))
    return n


def link_ranks(triples: DataFrame, embeddings: DataFrame, phases: Phases, filtered: DataFrame | None = None, pivots: int | None = None) -> DataFrame:
    """Triples with rank: 1 + the entities that are strictly nearer to the rotated head than the tail is; and compared, the
    entities whose distance had to be computed for it.

    Entities are in cells around pivots. By the triangle inequality the distances of a rotated head and of a cell to the
    pivots bound all distances between them: a cell whose entities all are nearer than the tail is counted, one whose
    entities all are not is skipped, and only the others meet the triple. There an entity's own distance to the cell's pivot
    bounds it again. Blocks of triples and of entities are written once and meet without a shuffle. The ranks are exact. filtered: known triples whose tails don't count. pivots:
    as many as make cells of CELL entities, PIVOTS at most, unless given.
    """
    test = triples.select("head_id", "angle_bin", "tail_id").distinct()
    own = scored(test, embeddings, phases)
    h = embeddings.select(F.col("node_id").alias("head_id"), F.col("embedding").alias("_h"))
    rows = own.join(h, "head_id").select("head_id", "angle_bin", "tail_id", "distance", rotate(F.col("_h"), phase_column(phases, F.col("angle_bin"))).alias("embedding"))
    entities, points = cells(embeddings, pivots or max(1, min(PIVOTS, embeddings.count() // CELL)))
    low, high, count = bounds(entities, points) if len(points) else (np.empty((0, 0)),) * 3
    smooth = points.shape[1] // 2 * 1e-4 + 1e-9  # the distance in use is the metric and this at most
    key = ["head_id", "angle_bin", "tail_id"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of triples whose nearest pivots are alike, each triple once, with what is known of it and the cells that it has to meet."""
        for t in grouped(batches, 16 * TRIPLES):
            x, own = matrix(t.column("embedding")), t.column("distance").to_numpy()
            d = plain_distance(x, points)
            sure, open_ = np.zeros(len(d), np.int64), np.zeros((len(d), len(count)), bool)
            for c in np.flatnonzero(count):
                least = np.maximum(low[c] - d, d - high[c]).max(1)
                within = (d + high[c]).min(1) + smooth < own - 1e-9
                sure += within * count[c]
                open_[:, c] = ~within & (least < own + 1e-9)
            order, ids = np.argsort(d.argmin(1), kind="stable"), [t.column(c).to_numpy() for c in key]
            for i in range(0, len(order), TRIPLES):
                at = order[i : i + TRIPLES]
                parts = [*(v[at].astype(np.int64) for v in ids), own[at], sure[at], open_[at], x[at]]
                yield pa.RecordBatch.from_arrays([*(pa.array([v.tobytes()], pa.binary()) for v in parts), pa.array([np.flatnonzero(open_[at].any(0)).astype(np.int32)], pa.list_(pa.int32()))], names=[*BLOCKS, "cells"])

    known = materialize(rows.mapInArrow(dealt, ", ".join(f"{c} binary" for c in BLOCKS) + ", cells array<int>"), "links-open")
    cells_ = packed_cells(entities)
    schema = "head_id long, angle_bin int, tail_id long, nearer long, compared long"

    def counted(block: dict, nearer: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
        ids = [np.frombuffer(block[c], np.int64) for c in BLOCKS[:3]]
        return pa.RecordBatch.from_arrays([pa.array(ids[0]), pa.array(ids[1].astype(np.int32)), pa.array(ids[2]), pa.array(nearer), pa.array(met)], names=[*key, "nearer", "compared"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sure = np.frombuffer(r["sure"], np.int64)
                yield counted(r, sure, np.zeros(len(sure), np.int64))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, met = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if block is None or any(block[c] != r[c] for c in BLOCKS):
                    if block is not None:
                        yield counted(block, n, met)
                    block, own = r, np.frombuffer(r["own"], np.float64)
                    n, met = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                    x, tail = np.frombuffer(r["turned"], np.float64).reshape(len(own), -1), np.frombuffer(r["tail"], np.int64)
                    open_ = np.frombuffer(r["open"], bool).reshape(len(own), -1)
                node, off = np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["off"], np.float64)
                y, at = np.frombuffer(r["vectors"], np.float64).reshape(len(node), -1), np.flatnonzero(open_[:, r["cell"]])
                away = plain_distance(x[at], points[[r["cell"]]])[:, 0]
                right, longest = single_columns(y), plain_distance(y, np.zeros((1, y.shape[1]))).max()
                order = np.argsort(away, kind="stable")
                at, away = at[order], away[order]
                for i in range(0, len(at), ROWS):
                    rows_, far = at[i : i + ROWS], away[i : i + ROWS]
                    # Rows that |away - off| leaves open for any of these triples, which lie at like distances from the pivot.
                    p, q = np.searchsorted(off, [(far - own[rows_]).min() - 1e-9, (far + own[rows_]).max() + 1e-9])
                    if q > p:
                        n[rows_] += nearer_rows(x[rows_], own[rows_], tail[rows_], y[p:q], node[p:q], right[..., p:q], longest)
                        met[rows_] += q - p
        if block is not None:
            yield counted(block, n, met)

    met = known.crossJoin(cells_.hint("shuffle_replicate_nl")).where(F.array_contains("cells", F.col("cell")))
    parts = met.mapInArrow(compare, schema).unionByName(known.mapInArrow(first, schema))
    ranks = parts.groupBy(*key).agg((F.sum("nearer") + 1).alias("rank"), F.sum("compared").alias("compared"))
    if filtered is None:
        return ranks
    known = filtered.select("head_id", "angle_bin", F.col("tail_id").alias("other")).distinct()
    pairs = own.join(known, ["head_id", "angle_bin"]).where("other <> tail_id").select("head_id", "angle_bin", F.col("tail_id").alias("tail"), "distance", F.col("other").alias("tail_id"))
    nearer = scored(pairs.withColumnRenamed("distance", "own"), embeddings, phases).where(F.col("distance") < F.col("own") - 1e-12)
    less = nearer.groupBy("head_id", "angle_bin", F.col("tail").alias("tail_id")).agg(F.count("*").alias("less"))
    return ranks.join(less, ["head_id", "angle_bin", "tail_id"], "left").select("head_id", "angle_bin", "tail_id", (F.col("rank") - F.coalesce("less", F.lit(0))).alias("rank"), "compared")


def link_metrics(ranks: DataFrame) -> DataFrame:
    """One row: mrr, hits_1, hits_3, hits_10, mean_rank."""
    hit = lambda k: F.avg((F.col("rank") <= k).cast("double")).alias(f"hits_{k}")
    return ranks.agg(F.avg(F.lit(1.0) / F.col("rank")).alias("mrr"), hit(1), hit(3), hit(10), F.avg("rank").alias("mean_rank"))


# graph encoder


def layer_normed(rows: DataFrame, column: str, dim: int) -> DataFrame:
    """(node_id, embedding): a column's vectors less their mean, over their deviation."""
    mean = F.aggregate(column, F.lit(0.0), lambda s, x: s + x) / dim
    out = rows.select("node_id", F.col(column).alias("v"), mean.alias("m"))
    out = out.withColumn("s", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("m")) * (x - F.col("m"))) / dim + 1e-5))
    return out.select("node_id", F.transform("v", lambda x: (x - F.col("m")) / F.col("s")).alias("embedding"))


def sums_by_node(to: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    """(node_id, sum, n) of a batch of messages: what a task sends to the shuffle."""
    nodes, at, n = np.unique(to, return_inverse=True, return_counts=True)
    total = np.zeros((len(nodes), vectors.shape[1]))
    np.add.at(total, at, vectors)
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(n)], names=["node_id", "sum", "n"])


def message_layer(features: DataFrame, edges: DataFrame, weights: np.ndarray, bias: np.ndarray, pool: str = "mean") -> DataFrame:
    """One layer: neighbours' vectors times their edge's bin matrix, pooled at the destination, added and layer-normalised.

    weights: (BINS, dim, dim). Sums form in the shuffle's map side, a row for each node and task; `max` acts as `sum`.
    """
    return layer_normed(message_sums(features, edges, weights, bias, pool), "v", weights.shape[2])


def message_sums(features: DataFrame, edges: DataFrame, weights: np.ndarray, bias: np.ndarray, pool: str = "mean") -> DataFrame:
    """(node_id, v): message_layer() before it is normalised."""
    rows = edges.join(features.withColumnRenamed("node_id", "src"), "src").select(F.col("dst").alias("node_id"), "bin", "embedding")

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, b = matrix(pa.chunked_array([batch.column("embedding")])), batch.column("bin").to_numpy()
                y = np.empty((len(x), weights.shape[2]))
                for k in np.unique(b):
                    y[b == k] = x[b == k] @ weights[k]
                yield sums_by_node(batch.column("node_id").to_numpy(), y)

    partial = rows.mapInArrow(messages, "node_id long, sum array<double>, n long")
    dim = weights.shape[2]
    pooled = partial.groupBy("node_id").agg(F.array(*(F.sum(F.col("sum")[i]) for i in range(dim))).alias("sum"), F.sum("n").alias("n"))
    over = (F.col("n") + 1e-8) if pool == "mean" else F.lit(1.0)
    joined = features.join(pooled, "node_id", "left")
    zero = F.array_repeat(F.lit(0.0), dim)
    arrived = F.transform(F.coalesce("sum", zero), lambda x: x / F.coalesce(over, F.lit(1.0)))
    added = F.zip_with(F.zip_with("embedding", arrived, lambda a, b: a + b), F.array(*map(F.lit, bias.tolist())), lambda a, b: a + b)
    return joined.select("node_id", added.alias("v"))


def encode_graph(features: DataFrame, edges: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], pool: str = "mean") -> DataFrame:
    """All layers, then unit vectors."""
    from .vectors import normalized

    for weights, bias in layers:
        features = materialize(message_layer(features, edges, weights, bias, pool), "encoder")
    return normalized(features)


Linear = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Attention:
    """One attention layer: (weight, bias) of queries, keys, values and the way out, all of one size, and a bias for each
    bin and head."""

    query: Linear
    key: Linear
    value: Linear
    out: Linear
    bin_bias: np.ndarray


def attention_layer(features: DataFrame, edges: DataFrame, layer: Attention) -> DataFrame:
    """One layer: values of sources, weighted by a softmax over all edges for each head, summed at the destination, sent
    out, added to the node's vector and layer-normalised.

    An edge's score is its destination's query times its source's key over the root of the head's size, and its bin's bias.
    The softmax needs a maximum and a sum for each head, which alone reach the driver; messages are summed by task first.
    """
    dim, heads = layer.query[0].shape[1], layer.bin_bias.shape[1]
    arrays = lambda v: pa.array(v.tolist(), pa.list_(pa.float64()))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(pa.chunked_array([batch.column("embedding")]))
                yield pa.RecordBatch.from_arrays([batch.column("node_id"), *(arrays(x @ w + b) for w, b in (layer.query, layer.key, layer.value))], names=["node_id", "q", "k", "v"])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, k = (matrix(pa.chunked_array([batch.column(c)])).reshape(batch.num_rows, heads, -1) for c in ("q", "k"))
                s = (q * k).sum(2) / math.sqrt(dim // heads) + layer.bin_bias[batch.column("bin").to_numpy()]
                yield pa.RecordBatch.from_arrays([batch.column("dst"), arrays(s), batch.column("v")], names=["dst", "s", "v"])

    made = materialize(features.select(F.col("node_id").cast("long").alias("node_id"), "embedding").mapInArrow(sides, "node_id long, q array<double>, k array<double>, v array<double>"), "attention-sides")
    ends = edges.select("src", "dst", "bin").join(made.select(F.col("node_id").alias("src"), "k", "v"), "src").join(made.select(F.col("node_id").alias("dst"), "q"), "dst")
    scored = materialize(ends.select(F.col("dst").cast("long").alias("dst"), "bin", "q", "k", "v").mapInArrow(scores, "dst long, s array<double>, v array<double>"), "attention-scores")
    most = scored.agg(*(F.max(F.col("s")[h]).alias(f"m{h}") for h in range(heads))).collect()[0]  # a value a head
    pooled = None
    if most[0] is not None:
        top = np.array(list(most))
        total = np.array(list(scored.agg(*(F.sum(F.exp(F.col("s")[h] - float(top[h]))).alias(f"t{h}") for h in range(heads))).collect()[0]))

        def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    s, v = (matrix(pa.chunked_array([batch.column(c)])) for c in ("s", "v"))
                    weight = np.exp(s - top) / total
                    yield sums_by_node(batch.column("dst").to_numpy(), (weight[:, :, None] * v.reshape(len(v), heads, -1)).reshape(len(v), -1))

        partial = scored.mapInArrow(messages, "node_id long, sum array<double>, n long")
        pooled = partial.groupBy("node_id").agg(F.array(*(F.sum(F.col("sum")[i]) for i in range(dim))).alias("sum"))
    zero = F.array_repeat(F.lit(0.0), dim)
    joined = features.join(pooled, "node_id", "left") if pooled is not None else features.withColumn("sum", F.lit(None).cast("array<double>"))
    sent = linear(joined.select("node_id", F.col("embedding").alias("own"), F.coalesce("sum", zero).alias("embedding")), *layer.out)
    return layer_normed(sent.withColumn("both", F.zip_with("own", "embedding", lambda a, b: a + b)), "both", dim)


def encode_with_attention(features: DataFrame, edges: DataFrame, inward: Linear, layers: list[Attention], outward: Linear) -> DataFrame:
    """Vectors sent in and cut off at zero, all layers, sent out, unit length. Forward only: dropout belongs to training."""
    from .vectors import normalized

    features = linear(features.select("node_id", "embedding"), *inward).select("node_id", F.transform("embedding", lambda x: F.greatest(x, F.lit(0.0))).alias("embedding"))
    for layer in layers:
        features = materialize(attention_layer(features, edges, layer), "attention-encoder")
    return normalized(linear(features, *outward))


def edge_attention(edges: DataFrame, features: DataFrame, bin_vectors: list[list[float]]) -> DataFrame:
    """(src, dst, pos, weight): softmax over all edges of the source vector's inner product with its bin's vector."""
    at = F.element_at(F.array(*(F.array(*map(F.lit, v)) for v in bin_vectors)), F.col("bin") + 1)
    x = edges.join(features.withColumnRenamed("node_id", "src"), "src").select("src", "dst", "pos", dot(F.col("embedding"), at).alias("x"))
    x = materialize(x, "attention")
    most = F.broadcast(x.agg(F.max("x").alias("most")))
    e = x.crossJoin(most).withColumn("e", F.exp(F.col("x") - F.col("most")))
    total = F.broadcast(e.agg(F.sum("e").alias("total")))
    return e.crossJoin(total).select("src", "dst", "pos", (F.col("e") / F.col("total")).alias("weight"))


def hashed_sentences(texts: DataFrame, dim: int = 256, instruction: str = "") -> DataFrame:
    """(document_id, embedding): the offline encoder, signed hashes of words, unit length. An instruction goes before each text.
    Other encoders plug in through `encode_with`."""
    from .vectors import normalized

    rows = materialize(texts.select("document_id", F.monotonically_increasing_id().alias("row"), F.concat(F.lit(instruction + " "), F.coalesce("text", F.lit(""))).alias("text")), "sentences")
    word = F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    h = rows.select("row", word.alias("w")).select("row", F.xxhash64("w").alias("h"))
    part = h.groupBy("row", F.pmod("h", F.lit(dim)).alias("i")).agg(F.sum(F.when(F.shiftright("h", 32).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)).alias("x"))
    maps = part.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))  # dim entries at most
    full = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return normalized(rows.select("document_id", "row").join(maps, "row", "left").select("document_id", full.alias("embedding")))  # texts without a word too: zeros


def encode_with(texts: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """(document_id, embedding) by any encoder; made once a task, called on batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            if batch.num_rows:
                encoder = encoder or make_encoder()
                v = encoder(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(v, float).tolist(), pa.list_(pa.float64()))], names=["document_id", "embedding"])

    return texts.select(F.col("document_id").cast("string"), "text").mapInArrow(run, "document_id string, embedding array<double>")


# Domain -> (public sentence encoder, its dimensions), to pass to encode_with where the model is installed.
ENCODERS = {
    "general": ("all-MiniLM-L6-v2", 384), "quality": ("all-mpnet-base-v2", 768), "speed": ("paraphrase-MiniLM-L3-v2", 384),
    "multilingual": ("paraphrase-multilingual-MiniLM-L12-v2", 384), "code": ("flax-sentence-embeddings/st-codesearch-distilroberta-base", 768),
    "medical": ("pritamdeka/S-PubMedBert-MS-MARCO", 768), "legal": ("nlpaueb/legal-bert-base-uncased", 768),
}
# Instructions that go before texts.
INSTRUCTIONS = {"query": "Represent the question for retrieval:", "document": "Represent the document for retrieval:"}


def recommended_encoder(domain: str = "general") -> tuple[str, int]:
    """Name and dimensions of the encoder for a domain; the general one for others."""
    return ENCODERS.get(domain, ENCODERS["general"])


def encode_instructed(texts: DataFrame, kind: str, make_encoder: Callable[[], Callable[[list[tuple[str, str]]], np.ndarray]]) -> DataFrame:
    """(document_id, embedding) by an encoder that takes (instruction, text) pairs; kind: `query` or `document`."""
    said = INSTRUCTIONS[kind]

    def paired() -> Callable[[list[str]], np.ndarray]:
        encoder = make_encoder()
        return lambda batch: encoder([(said, t) for t in batch])

    return encode_with(texts, paired)


def linear(embeddings: DataFrame, weight: np.ndarray, bias: np.ndarray) -> DataFrame:
    """v W + b; other columns pass. weight (dim, out), or (BINS, dim, out) with a column `bin`."""
    by_bin = weight.ndim == 3
    keys = [c for c in embeddings.columns if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(pa.chunked_array([batch.column("embedding")]))
                y = np.einsum("nd,ndo->no", x, weight[batch.column("bin").to_numpy()]) if by_bin else x @ weight
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array((y + bias).tolist(), pa.list_(pa.float64()))], names=[*keys, "embedding"])

    schema = ", ".join(f"{k} {t}" for k, t in embeddings.dtypes if k != "embedding") + ", embedding array<double>"
    return embeddings.select(*keys, "embedding").mapInArrow(run, schema)


def projected(embeddings: DataFrame, weight: np.ndarray, bias: np.ndarray) -> DataFrame:
    """A fine-tuned head's forward pass: linear(), unit length."""
    from .vectors import normalized

    return normalized(linear(embeddings, weight, bias))


def rotated_texts(embeddings: DataFrame, phases: Phases, bin_: Column | None = None, weight: np.ndarray | None = None) -> DataFrame:
    """Text vectors as entities: projected to the phases' size where a weight is given, rotated where a bin is. The encoder is
    any that encode_with or hashed_sentences stands for."""
    if weight is not None:
        keys = [c for c in embeddings.columns if c != "embedding"]
        w = F.array(*(F.array(*map(F.lit, column)) for column in weight.T.tolist()))
        embeddings = embeddings.select(*keys, F.transform(w, lambda column: dot(F.col("embedding"), column)).alias("embedding"))
    if bin_ is None:
        return embeddings
    return embeddings.withColumn("embedding", rotate(F.col("embedding"), phase_column(phases, bin_)))


# training


class Callback:
    """Hooks of training, on the driver; a true result of after_epoch ends it."""

    def before_training(self, config: TrainConfig) -> None: ...

    def after_epoch(self, epoch: int, metrics: dict, model: tuple[DataFrame, Phases]) -> bool:
        return False


class History(Callback):
    """Metrics of every epoch; `frame` makes them a table."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def after_epoch(self, epoch: int, metrics: dict, model) -> bool:
        self.rows.append({"epoch": epoch, **metrics})
        return False

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r["epoch"], r["loss"]) for r in self.rows], "epoch int, loss double")


class EarlyStop(Callback):
    """Ends training when the loss hasn't fallen by `least` for `patience` epochs."""

    def __init__(self, patience: int = 3, least: float = 1e-4) -> None:
        self.patience, self.least, self.best, self.since = patience, least, math.inf, 0

    def after_epoch(self, epoch: int, metrics: dict, model) -> bool:
        better = metrics["loss"] < self.best - self.least
        self.best, self.since = (metrics["loss"], 0) if better else (self.best, self.since + 1)
        return self.since >= self.patience


class Checkpoint(Callback):
    """Writes the model every `every` epochs under a path."""

    def __init__(self, path: str, every: int = 1) -> None:
        self.path, self.every = path, every

    def after_epoch(self, epoch: int, metrics: dict, model) -> bool:
        if epoch % self.every == 0:
            save_model(model, f"{self.path}/epoch-{epoch:04d}")
        return False


class Log(Callback):
    def after_epoch(self, epoch: int, metrics: dict, model) -> bool:
        from ..logs import get_logger

        get_logger(__name__).info("epoch %d: %s", epoch, metrics)
        return False


def save_model(model: tuple[DataFrame, Phases], path: str) -> None:
    """Entities and phases as Parquet tables below a path."""
    entities, phases = model
    spark = entities.sparkSession
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    spark.createDataFrame(list(enumerate(phases)), "bin int, phase array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/phases")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, Phases]:
    rows = spark.read.parquet(f"{path}/phases").orderBy("bin").collect()  # BINS rows
    return spark.read.parquet(f"{path}/entities"), [r.phase for r in rows]


def learning_rate(step: int, steps: int, peak: float, warmup: float = 0.1) -> float:
    """Linear warm-up, then a cosine to zero."""
    start = max(1, int(steps * warmup))
    return peak * (step + 1) / start if step < start else peak * 0.5 * (1 + math.cos(math.pi * (step - start) / max(1, steps - start)))


#: Decay of the two moments, and what keeps the second from zero.
MOMENTS, TINY_MOMENT = (0.9, 0.999), 1e-8


def train_rotation(triples: DataFrame, num_entities: int, config: TrainConfig = TrainConfig(), callbacks: list[Callback] = ()) -> tuple[DataFrame, Phases]:
    """Entities and phases by gradient descent, in steps_per_epoch distributed steps an epoch.

    Entity vectors, and their moments where the optimizer has some, stay a table: each step joins them to its triples and
    seeded negatives, tasks compute gradients for their rows with numpy, and sums by entity update the table. Phases are
    BINS rows. The rate warms up and falls by steps. A step without triples changes nothing.
    """
    if config.optimizer not in ("plain", "adamw"):
        raise ValueError(f"no optimizer is called {config.optimizer}")
    adamw, steps = config.optimizer == "adamw", max(1, config.steps_per_epoch)
    spark = triples.sparkSession
    entities, phases = initial_entities(spark, num_entities, config.dim, config.seed), initial_phases(config.dim, config.seed)
    if adamw:
        zeros = F.array_repeat(F.lit(0.0), config.dim)
        entities = entities.withColumns({"first": zeros, "second": zeros})
    entities = materialize(entities, "kge")
    phase_moments = np.zeros((2, BINS, config.dim // 2))
    for c in callbacks:
        c.before_training(config)
    half = config.dim // 2
    dealt = F.pmod(F.xxhash64("head_id", "angle_bin", "tail_id", F.lit(config.seed + 1)), F.lit(steps))
    for epoch in range(config.epochs):
        total_loss, seen = 0.0, 0
        for part in range(steps):
            number, some = epoch * steps + part, triples if steps == 1 else triples.where(dealt == part)
            rate = learning_rate(number, config.epochs * steps, config.learning_rate)
            summed = _gradient_sums(some, triples, entities, phases, num_entities, config, epoch)
            n = some.count()
            totals = summed.agg(F.coalesce(F.sum("loss"), F.lit(0.0)).alias("loss"), F.coalesce(F.sum(_squares("g")), F.lit(0.0)).alias("squares")).collect()[0]
            total_loss, seen = total_loss + totals.loss, seen + n
            if not n:
                continue
            now = entities.join(summed.where("key >= 0").select(F.col("key").alias("node_id"), "g"), "node_id", "left")
            if adamw:
                mean = 1.0 / n / max(1.0, math.sqrt(totals.squares) / n / config.max_grad_norm)
                entities = materialize(_adamw(now, mean, rate, number + 1, config), "kge")
                g = np.zeros((BINS, half))
                for r in summed.where("key < 0").collect():  # BINS rows at most
                    g[-1 - r.key] = np.array(r.g[:half]) * mean
                moved, *moments = _adamw_step(np.array(phases), g, *phase_moments, rate, number + 1, config)
                phases, phase_moments = moved.tolist(), np.stack(moments)
            else:
                step = F.lit(rate) / F.greatest(F.sqrt(_squares("g")), F.lit(1.0))
                moved = F.zip_with("embedding", "g", lambda v, g: v - g * F.col("step"))
                entities = materialize(now.withColumn("step", step).select("node_id", F.when(F.col("g").isNull(), F.col("embedding")).otherwise(moved).alias("embedding")), "kge")
                for r in summed.where("key < 0").collect():  # BINS rows at most
                    g = np.array(r.g[:half])
                    phases[-1 - r.key] = (np.array(phases[-1 - r.key]) - rate * g / max(1.0, float(np.linalg.norm(g)))).tolist()
        metrics = {"loss": total_loss / max(1, seen)}
        model = entities.select("node_id", "embedding"), phases
        if any([c.after_epoch(epoch, metrics, model) for c in callbacks]):
            break
    return entities.select("node_id", "embedding"), phases


def _squares(column: str) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x)


def _adamw_step(v: np.ndarray, g: np.ndarray, first: np.ndarray, second: np.ndarray, rate: float, t: int, config: TrainConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, second = MOMENTS[0] * first + (1 - MOMENTS[0]) * g, MOMENTS[1] * second + (1 - MOMENTS[1]) * g * g
    ahead = first / (1 - MOMENTS[0] ** t) / (np.sqrt(second / (1 - MOMENTS[1] ** t)) + TINY_MOMENT)
    return v - rate * (ahead + config.weight_decay * v), first, second


def _adamw(rows: DataFrame, scale: float, rate: float, t: int, config: TrainConfig) -> DataFrame:
    """Entities (node_id, embedding, first, second) after a step along their summed gradients g times scale; none is zero."""
    b1, b2 = MOMENTS
    g = F.transform(F.coalesce("g", F.array_repeat(F.lit(0.0), config.dim)), lambda x: x * scale)
    rows = rows.withColumn("g", g)
    rows = rows.withColumns({"first": F.zip_with("first", "g", lambda m, x: m * b1 + x * (1 - b1)), "second": F.zip_with("second", "g", lambda m, x: m * b2 + x * x * (1 - b2))})
    ahead = F.zip_with("first", "second", lambda m, s: m / (1 - b1**t) / (F.sqrt(s / (1 - b2**t)) + TINY_MOMENT))
    return rows.select("node_id", F.zip_with("embedding", ahead, lambda v, d: v - (d + v * config.weight_decay) * rate).alias("embedding"), "first", "second")


def _gradient_sums(some: DataFrame, triples: DataFrame, entities: DataFrame, phases: Phases, num_entities: int, config: TrainConfig, epoch: int) -> DataFrame:
    """(key, g, loss), written: sums over some of the triples and their negatives. key: an entity, or -1 - bin for phases."""
    from .triples import negatives

    half, gamma = config.dim // 2, config.gamma
    bad = negatives(triples, num_entities, config.negatives, config.seed + epoch, of=None if some is triples else some)
    rows = bad.select("head_id", "angle_bin", "tail_id", F.lit(-1.0 / config.negatives).alias("sign"), F.col("negative").alias("other"))
    rows = rows.unionByName(some.select("head_id", "angle_bin", "tail_id", F.lit(1.0).alias("sign"), F.col("tail_id").alias("other")))
    h = entities.select(F.col("node_id").alias("head_id"), F.col("embedding").alias("h"))
    t = entities.select(F.col("node_id").alias("other"), F.col("embedding").alias("t"))
    ready = rows.join(h, "head_id").join(t, "other").select("head_id", "other", "angle_bin", "sign", "h", "t")
    now = np.array(phases)

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (matrix(pa.chunked_array([batch.column(c)])) for c in ("h", "t"))
            b, sign = batch.column("angle_bin").to_numpy(), batch.column("sign").to_numpy()
            c, s = np.cos(now[b]), np.sin(now[b])
            re, im = x[:, :half] * c - x[:, half:] * s, x[:, :half] * s + x[:, half:] * c
            a, d = re - y[:, :half], im - y[:, half:]
            each = np.sqrt(a * a + d * d + 1e-8)
            z = np.where(sign > 0, gamma - each.sum(1), each.sum(1) - gamma)
            loss = np.abs(sign) * np.logaddexp(0, -z)
            slope = (sign / (1 + np.exp(np.clip(z, -40, 40))))[:, None]  # d loss / d distance
            ga, gd = slope * a / each, slope * d / each
            head = np.hstack([ga * c + gd * s, -ga * s + gd * c])
            turn = ga * (-im) + gd * re
            g = np.vstack([head, -np.hstack([ga, gd])])
            ids = np.concatenate([batch.column("head_id").to_numpy(), batch.column("other").to_numpy()])
            nodes, at = np.unique(ids, return_inverse=True)
            total = np.zeros((len(nodes), config.dim))
            np.add.at(total, at, g)
            bins, bat = np.unique(b, return_inverse=True)
            phase = np.zeros((len(bins), config.dim))
            np.add.at(phase[:, :half], bat, turn)
            keys = np.concatenate([nodes, -1 - bins])
            losses = np.zeros(len(keys))
            losses[0] = loss.sum()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.vstack([total, phase]).tolist(), pa.list_(pa.float64())), pa.array(losses)], names=["key", "g", "loss"])

    made = ready.mapInArrow(gradients, "key long, g array<double>, loss double")
    return materialize(made.groupBy("key").agg(F.array(*(F.sum(F.col("g")[i]) for i in range(config.dim))).alias("g"), F.sum("loss").alias("loss")), "kge-step")
