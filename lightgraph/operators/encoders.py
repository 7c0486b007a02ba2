"""Training of graph and text encoders: layers forward and backward, neighbour sampling, a loss within batches.

An encoder is a list of layers. Vectors, messages and their gradients are tables; a layer's parameters are numpy arrays of
the model's size, which tasks get and of whose gradients tasks send sums. The way forward goes along edges, the way back
along the same edges reversed. A text head is an encoder of one Dense layer, which needs no edges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import TINY
from ..params import BINS, TrainConfig
from ..session import discard, materialize
from .kge import Callback, _adamw_step, learning_rate, message_sums, sums_by_node
from .vectors import matrix, normalized


@dataclass(frozen=True)
class Dense:
    """v W + b, cut off at zero where `relu`."""

    weight: np.ndarray
    bias: np.ndarray
    relu: bool = False


@dataclass(frozen=True)
class Message:
    """kge.message_layer: weights (BINS, dim, dim), bias, pool."""

    weights: np.ndarray
    bias: np.ndarray
    pool: str = "mean"


@dataclass(frozen=True)
class Attend:
    """kge.attention_layer with its matrices side by side: qkv (dim, 3 dim) and out (dim, dim), their biases, and a bias for
    each bin and head."""

    qkv: np.ndarray
    qkv_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    bin_bias: np.ndarray


Layer = Dense | Message | Attend
KINDS = {"dense": Dense, "message": Message, "attend": Attend}


def parameters(layer: Layer) -> dict[str, np.ndarray]:
    return {f.name: getattr(layer, f.name) for f in fields(layer) if isinstance(getattr(layer, f.name), np.ndarray)}


def initial_layers(sizes: tuple[int, ...], messages: int = 2, heads: int = 0, pool: str = "mean", seed: int = 42) -> list[Layer]:
    """Dense layers through `sizes`, cut off at zero before the last, and `messages` layers of the second size after the first: of attention where
    there are heads. Weights are normal with deviation 1 / sqrt(size)."""
    rng = np.random.default_rng(seed)
    drawn = lambda *shape: rng.standard_normal(shape) / math.sqrt(shape[-2])
    dense = [Dense(drawn(a, b), np.zeros(b), i < len(sizes) - 2) for i, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False))]
    dim = sizes[1]
    if heads:
        middle = [Attend(drawn(dim, 3 * dim), np.zeros(3 * dim), drawn(dim, dim), np.zeros(dim), np.zeros((BINS, heads))) for _ in range(messages)]
    else:
        middle = [Message(drawn(BINS, dim, dim), np.zeros(dim), pool) for _ in range(messages)]
    return [dense[0], *middle, *dense[1:]]


# tables of vectors


def arrays(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), np.ascontiguousarray(v).ravel())


def mapped(rows: DataFrame, schema: str, make) -> DataFrame:
    """make(columns) on batches: lists come as matrices, other columns as arrays; gives columns in the schema's order."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = {n: matrix(pa.chunked_array([c])) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                yield pa.RecordBatch.from_arrays([arrays(v) if v.ndim == 2 else pa.array(v) for v in make(columns)], names=names)

    return rows.mapInArrow(run, schema)


def summed(rows: DataFrame, dim: int) -> DataFrame:
    """(node_id, g): sums of (node_id, sum) by node."""
    return rows.groupBy("node_id").agg(F.array(*(F.sum(F.col("sum")[i]) for i in range(dim))).alias("g"))


def total(rows: DataFrame, dim: int) -> np.ndarray:
    """(dim,): the sum over a column `s` of vectors; zeros where there are none."""
    r = rows.agg(*(F.sum(F.col("s")[i]) for i in range(dim))).collect()[0]
    return np.array([x or 0.0 for x in r])


def outer_sums(rows: DataFrame, left: str, right: str, shape: tuple[int, int], by: str | None = None) -> np.ndarray:
    """(BINS or 1, left + 1, right): sums over rows of the products of two vectors, by bin; the last row of each is the sum of the right
    ones. A task keeps one such array and sends its rows."""
    n, m = shape[0] + 1, shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BINS if by else 1, n, m))
        for batch in batches:
            if batch.num_rows:
                y = matrix(pa.chunked_array([batch.column("r")]))
                x = np.hstack([matrix(pa.chunked_array([batch.column("l")])).reshape(len(y), n - 1), np.ones((len(y), 1))])
                b = batch.column("b").to_numpy() if by else np.zeros(len(y), int)
                for k in np.unique(b):
                    sums[k] += x[b == k].T @ y[b == k]
        flat = sums.reshape(-1, m)
        some = np.flatnonzero(flat.any(1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), arrays(flat[some])], names=["node_id", "sum"])

    l_, b = F.col(left) if left else F.array().cast("array<double>"), F.col(by) if by else F.lit(0)
    parts = rows.select(l_.alias("l"), F.col(right).alias("r"), b.cast("int").alias("b")).mapInArrow(run, "node_id long, sum array<double>")
    out = np.zeros(((BINS if by else 1) * n, m))
    for r in summed(parts, m).collect():  # a row for each row of the layer's matrices
        out[r.node_id] = r.g
    return out.reshape(-1, n, m)


def normed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sqrt(v.var(1, keepdims=True) + 1e-5)
    return (v - v.mean(1, keepdims=True)) / s, s


def through_norm(raw: DataFrame, g: DataFrame, *more: str) -> DataFrame:
    """(node_id, g, more): gradients of layer-normalised vectors v, of which nodes without a gradient have none."""

    def back(c: dict) -> list:
        x, s = normed(c["v"])
        at = c["g"]
        return [c["node_id"], (at - at.mean(1, keepdims=True) - x * (at * x).mean(1, keepdims=True)) / s, *(c[m] for m in more)]

    schema = "node_id long, g array<double>" + "".join(f", {m} array<double>" for m in more)
    return mapped(raw.select("node_id", "v", *more).join(g, "node_id"), schema, back)


# layers


@dataclass
class Step:
    """What a layer leaves for the way back: its input, edges, and written tables."""

    layer: Layer
    x: DataFrame
    edges: DataFrame | None
    tables: dict[str, DataFrame]
    soft: tuple[np.ndarray, np.ndarray] | None = None


def forward(layer: Layer, x: DataFrame, edges: DataFrame | None, nodes: DataFrame | None = None) -> tuple[DataFrame, Step]:
    """A layer's vectors (node_id, embedding) of `nodes`, or all, and its Step. x is written."""
    if isinstance(layer, Dense):
        return _dense(layer, x, nodes)
    if isinstance(layer, Message):
        raw = only(message_sums(x, edges, layer.weights, layer.bias, layer.pool), nodes)
        step = Step(layer, x, edges, {"raw": materialize(raw, "encoder-raw")})
    else:
        step = _attend(layer, x, edges, nodes)
    return mapped(step.tables["raw"].select("node_id", "v"), "node_id long, embedding array<double>", lambda c: [c["node_id"], normed(c["v"])[0]]), step


def only(rows: DataFrame, nodes: DataFrame | None) -> DataFrame:
    return rows if nodes is None else rows.join(nodes, "node_id", "left_semi")


def _dense(layer: Dense, x: DataFrame, nodes: DataFrame | None) -> tuple[DataFrame, Step]:
    def make(c: dict) -> list:
        y = c["embedding"] @ layer.weight + layer.bias
        return [c["node_id"], np.maximum(y, 0) if layer.relu else y]

    return mapped(only(x, nodes), "node_id long, embedding array<double>", make), Step(layer, x, None, {})


def _attend(layer: Attend, x: DataFrame, edges: DataFrame, nodes: DataFrame | None) -> Step:
    dim, heads = layer.out.shape[0], layer.bin_bias.shape[1]

    def sides(c: dict) -> list:
        y = c["embedding"] @ layer.qkv + layer.qkv_bias
        return [c["node_id"], y[:, :dim], y[:, dim : 2 * dim], y[:, 2 * dim :]]

    def scores(c: dict) -> list:
        q, k = (c[n].reshape(len(c[n]), heads, -1) for n in "qk")
        return [c["src"], c["dst"], c["bin"], (q * k).sum(2) / math.sqrt(dim // heads) + layer.bin_bias[c["bin"]]]

    made = materialize(mapped(x, "node_id long, q array<double>, k array<double>, v array<double>", sides), "encoder-sides")
    ends = edges.select("src", "dst", "bin").join(made.select(F.col("node_id").alias("src"), "k"), "src").join(made.select(F.col("node_id").alias("dst"), "q"), "dst")
    scored = materialize(mapped(ends.select("src", "dst", "bin", "q", "k"), "src long, dst long, bin int, s array<double>", scores), "encoder-scores")
    top = np.array([r if r is not None else 0.0 for r in scored.agg(*(F.max(F.col("s")[h]) for h in range(heads))).collect()[0]])
    over = total(mapped(scored.select("s"), "s array<double>", lambda c: [np.exp(c["s"] - top)]), heads)
    tables = {"sides": made, "scores": scored}

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s, v = (matrix(pa.chunked_array([batch.column(c)])) for c in "sv")
                w = np.exp(s - top) / over
                yield sums_by_node(batch.column("dst").to_numpy(), (w[:, :, None] * v.reshape(len(v), heads, -1)).reshape(len(v), -1))

    sent = scored.select("src", "dst", "s").join(made.select(F.col("node_id").alias("src"), "v"), "src").select("dst", "s", "v")
    arrived = summed(sent.mapInArrow(messages, "node_id long, sum array<double>, n long"), dim)
    joined = only(x, nodes).join(arrived, "node_id", "left").select("node_id", "embedding", F.coalesce("g", F.array_repeat(F.lit(0.0), dim)).alias("sum"))
    raw = mapped(joined, "node_id long, sum array<double>, v array<double>", lambda c: [c["node_id"], c["sum"], c["embedding"] + c["sum"] @ layer.out + layer.out_bias])
    return Step(layer, x, edges, {**tables, "raw": materialize(raw, "encoder-raw")}, (top, over))


def backward(step: Step, g: DataFrame) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """(node_id, g) of a layer's input, written, and the gradients of its parameters, from those of its output. g is written."""
    if isinstance(step.layer, Dense):
        return _dense_back(step.layer, step, g)
    return (_message_back if isinstance(step.layer, Message) else _attend_back)(step.layer, step, g)


def _dense_back(layer: Dense, step: Step, g: DataFrame) -> tuple[DataFrame, dict[str, np.ndarray]]:
    def cut(c: dict) -> list:
        at = c["g"] * (c["embedding"] @ layer.weight + layer.bias > 0) if layer.relu else c["g"]
        return [c["node_id"], c["embedding"], at, at @ layer.weight.T]

    rows = materialize(mapped(step.x.select("node_id", "embedding").join(g, "node_id"), "node_id long, x array<double>, y array<double>, g array<double>", cut), "encoder-back")
    sums = outer_sums(rows, "x", "y", layer.weight.shape)[0]
    rows_back = rows.select("node_id", "g")
    rows_back.written_at = rows.written_at
    return rows_back, {"weight": sums[:-1], "bias": sums[-1]}


def _message_back(layer: Message, step: Step, g: DataFrame) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """Gradients go from destinations to sources: an edge's message gets its destination's share, and the source that times
    the bin's matrix."""
    dim = layer.weights.shape[1]
    own = materialize(through_norm(step.tables["raw"], g), "encoder-own")
    degrees = step.edges.groupBy("dst").agg(F.count("*").alias("n")).withColumnRenamed("dst", "node_id")
    share = F.col("n") + 1e-8 if layer.pool == "mean" else F.lit(1.0)
    shares = own.join(degrees, "node_id").select(F.col("node_id").alias("dst"), F.transform("g", lambda v: v / share).alias("g"))
    reverse = materialize(step.edges.select("src", "dst", "bin").join(shares, "dst").join(step.x.select(F.col("node_id").alias("src"), "embedding"), "src").select("src", F.col("bin").cast("int").alias("bin"), "embedding", "g"), "encoder-reverse")

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y, b = matrix(pa.chunked_array([batch.column("g")])), batch.column("bin").to_numpy()
                x = np.empty((len(y), dim))
                for k in np.unique(b):
                    x[b == k] = y[b == k] @ layer.weights[k].T
                yield sums_by_node(batch.column("src").to_numpy(), x)

    sums = outer_sums(reverse, "embedding", "g", (dim, layer.weights.shape[2]), "bin")
    bias = outer_sums(own, "", "g", (0, dim))[0, 0]
    sent = reverse.select("src", "bin", "g").mapInArrow(messages, "node_id long, sum array<double>, n long").select("node_id", "sum")
    out = materialize(summed(sent.unionByName(own.select("node_id", F.col("g").alias("sum"))), dim), "encoder-back")
    discard(own, reverse)
    return out, {"weights": sums[:, :-1], "bias": bias}


def _attend_back(layer: Attend, step: Step, g: DataFrame) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """The softmax is over all edges, so each edge's score moves with the weighted mean of all messages' gradients: one number a head."""
    dim, heads = layer.out.shape[0], layer.bin_bias.shape[1]
    (top, over), made = step.soft, step.tables["sides"]
    wide = lambda v: v.reshape(len(v), heads, -1)
    own = materialize(through_norm(step.tables["raw"], g, "sum"), "encoder-own")
    out = outer_sums(own, "sum", "g", layer.out.shape)[0]
    arrived = mapped(own.select("node_id", "g"), "dst long, a array<double>", lambda c: [c["node_id"], c["g"] @ layer.out.T])

    def weigh(c: dict) -> list:
        w = np.exp(c["s"] - top) / over
        return [c["src"], c["dst"], c["bin"], w, (wide(c["a"]) * wide(c["v"])).sum(2), (w[:, :, None] * wide(c["a"])).reshape(len(w), dim)]

    zero = F.array_repeat(F.lit(0.0), dim)
    met = step.tables["scores"].join(made.select(F.col("node_id").alias("src"), "v"), "src").join(arrived, "dst", "left").withColumn("a", F.coalesce("a", zero))
    weighed = materialize(mapped(met.select("src", "dst", "bin", "s", "v", "a"), "src long, dst long, bin int, w array<double>, gw array<double>, gv array<double>", weigh), "encoder-weights")
    mean = total(mapped(weighed.select("w", "gw"), "s array<double>", lambda c: [c["w"] * c["gw"]]), heads)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w, gw, gv, q, k = (matrix(pa.chunked_array([batch.column(c)])) for c in ("w", "gw", "gv", "q", "k"))
                gs = (w * (gw - mean))[:, :, None] / math.sqrt(dim // heads)
                gq, gk = ((gs * wide(v)).reshape(len(w), dim) for v in (k, q))
                none = np.zeros_like(gq)
                to = np.concatenate([batch.column("dst").to_numpy(), batch.column("src").to_numpy()])
                yield sums_by_node(to, np.vstack([np.hstack([gq, none, none]), np.hstack([none, gk, gv])]))

    both = weighed.join(made.select(F.col("node_id").alias("src"), "k"), "src").join(made.select(F.col("node_id").alias("dst"), "q"), "dst")
    sides = materialize(summed(both.mapInArrow(ends, "node_id long, sum array<double>, n long"), 3 * dim).join(step.x.select("node_id", "embedding"), "node_id"), "encoder-sides-back")
    qkv = outer_sums(sides, "embedding", "g", (dim, 3 * dim))[0]
    bins = outer_sums(mapped(weighed.select("bin", "w", "gw"), "bin int, s array<double>", lambda c: [c["bin"], c["w"] * (c["gw"] - mean)]), "", "s", (0, heads), "bin")
    sent = mapped(sides.select("node_id", "g"), "node_id long, sum array<double>", lambda c: [c["node_id"], c["g"] @ layer.qkv.T])
    back = materialize(summed(sent.unionByName(own.select("node_id", F.col("g").alias("sum"))), dim), "encoder-back")
    discard(own, weighed, sides)
    return back, {"qkv": qkv[:-1], "qkv_bias": qkv[-1], "out": out[:-1], "out_bias": out[-1], "bin_bias": bins[:, 0]}


# training


def neighbourhoods(edges: DataFrame | None, wanted: DataFrame, layers: list[Layer], fanout: int, seed: int) -> list[tuple[DataFrame, DataFrame | None]]:
    """For each layer, first to last: the nodes (node_id) whose vectors it has to give, and its edges, all written.

    Back from the nodes wanted last, a layer over edges needs those into its nodes: `fanout` of each node's at most, those with the
    least hashes, or all where fanout is 0. What a step reads grows with its batch and the fanout, not with the graph.
    """
    nodes, out = materialize(wanted.distinct(), "encoder-nodes"), []
    for i in reversed(range(len(layers))):
        if isinstance(layers[i], Dense):
            out.append((nodes, None))
            continue
        into = edges.select("src", "dst", "pos", "bin").join(nodes.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
        if fanout:
            by = Window.partitionBy("dst").orderBy(F.xxhash64("src", "pos", "bin", F.lit(seed * len(layers) + i)), "src", "pos", "bin")
            into = into.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= fanout).drop("_rank")
        into = materialize(into, "encoder-edges")
        out.append((nodes, into))
        nodes = materialize(nodes.unionByName(into.select(F.col("src").alias("node_id"))).distinct(), "encoder-nodes")
    return out[::-1]


def in_batch_gradients(pairs: DataFrame, vectors: DataFrame, dim: int, size: int, scale: float = 20.0) -> tuple[DataFrame, float, int]:
    """((node_id, g) written, loss, pairs): the sum of kge.in_batch_loss over batches of pairs (query, document), and its gradients.

    Distinct pairs are dealt to batches by a hash, `size` each on average; a pair with a node that has no vector is left out.
    """
    pairs = pairs.select("query", "document").distinct()
    batches = max(1, -(-pairs.count() // size))
    side = lambda node, name: vectors.select(F.col("node_id").alias(node), F.col("embedding").alias(name))
    rows = pairs.withColumn("batch", F.pmod(F.xxhash64("query", "document"), F.lit(batches))).join(side("query", "q"), "query").join(side("document", "d"), "document")

    def batch(t: pa.Table) -> pa.Table:
        q, d = matrix(t.column("q")), matrix(t.column("d"))
        lengths = [np.linalg.norm(v, axis=1, keepdims=True) for v in (q, d)]
        u, w = (np.where(n >= TINY, v / np.maximum(n, TINY), 0.0) for v, n in zip((q, d), lengths, strict=True))
        x = scale * u @ w.T
        x -= x.max(1, keepdims=True)
        e = np.exp(x).sum(1)
        gx = scale * (np.exp(x) / e[:, None] - np.eye(len(x)))
        g = [np.where(n >= TINY, (gv - v * (gv * v).sum(1, keepdims=True)) / np.maximum(n, TINY), 0.0) for v, n, gv in ((u, lengths[0], gx @ w), (w, lengths[1], gx.T @ u))]
        sums = sums_by_node(np.concatenate([t.column("query").to_numpy(), t.column("document").to_numpy()]), np.vstack(g))
        first = np.arange(sums.num_rows) == 0
        return pa.table({"node_id": sums.column("node_id"), "sum": sums.column("sum"), "loss": first * (np.log(e) - np.diag(x)).sum(), "n": first * len(x)})

    parts = materialize(rows.groupBy("batch").applyInArrow(batch, "node_id long, sum array<double>, loss double, n long"), "encoder-loss")
    r = parts.agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).collect()[0]
    g = materialize(summed(parts, dim), "encoder-loss-back")
    discard(parts)
    return g, r.loss or 0.0, r.n or 0


def encode(features: DataFrame, edges: DataFrame | None, layers: list[Layer]) -> DataFrame:
    """(node_id, embedding) of unit length, by all layers."""
    x = features.select(F.col("node_id").cast("long").alias("node_id"), _doubles("embedding"))
    for layer in layers:
        x = materialize(forward(layer, x, edges)[0], "encoder")
    return normalized(x)


def _doubles(column: str) -> Column:
    return F.transform(column, lambda v: v.cast("double")).alias(column)


def gradients(features: DataFrame, edges: DataFrame | None, pairs: DataFrame, layers: list[Layer], size: int = 512, fanout: int = 0, seed: int = 0, scale: float = 20.0) -> tuple[float, int, list[dict[str, np.ndarray]], DataFrame]:
    """(loss, pairs, gradients of each layer's parameters, (node_id, g) of the features): sums over the pairs, not means."""
    wanted = pairs.select(F.col("query").cast("long").alias("node_id")).unionByName(pairs.select(F.col("document").cast("long").alias("node_id")))
    levels = neighbourhoods(edges, wanted, layers, fanout, seed)
    first = levels[0][0]
    if levels[0][1] is not None:
        first = first.unionByName(levels[0][1].select(F.col("src").alias("node_id"))).distinct()
    rows = features.select(F.col("node_id").cast("long").alias("node_id"), _doubles("embedding"))
    x, steps = materialize(only(rows, first), "encoder-features"), []
    written = [x]
    for layer, (nodes, into) in zip(layers, levels, strict=True):
        y, step = forward(layer, x, into, nodes)
        x = materialize(y, "encoder-out")
        steps.append(step)
        written += [x, *step.tables.values()]
    dim = parameters(layers[-1])["out_bias" if isinstance(layers[-1], Attend) else "bias"].shape[0]
    g, loss, n = in_batch_gradients(pairs, x, dim, size, scale)
    found: list[dict[str, np.ndarray]] = []
    for step in reversed(steps):
        below, own = backward(step, g)
        discard(g)
        g = below
        found.append(own)
    for nodes, into in levels:
        written += [nodes] + ([into] if into is not None else [])
    discard(*written)
    return loss, n, found[::-1], g


def train_encoder(features: DataFrame, edges: DataFrame | None, pairs: DataFrame, layers: list[Layer], config: TrainConfig = TrainConfig(), callbacks: list[Callback] = (), fanout: int = 10, scale: float = 20.0) -> list[Layer]:
    """Layers trained so that each pair's nodes (query, document) are nearer than the other documents of its batch.

    A step has the pairs that a hash deals it, config.steps_per_epoch an epoch, in batches of config.batch_size, over a sample of
    neighbours that changes by epoch. Gradients are means over its pairs, clipped together by one norm; moments with decay where the
    optimizer is `adamw`. A step without pairs changes nothing. Written tables are deleted after each step.
    """
    if config.optimizer not in ("plain", "adamw"):
        raise ValueError(f"no optimizer is called {config.optimizer}")
    for c in callbacks:
        c.before_training(config)
    steps = max(1, config.steps_per_epoch)
    moments = [{k: np.zeros((2, *v.shape)) for k, v in parameters(layer).items()} for layer in layers]
    dealt = F.pmod(F.xxhash64("query", "document", F.lit(config.seed + 1)), F.lit(steps))
    for epoch in range(config.epochs):
        total_loss, seen = 0.0, 0
        for part in range(steps):
            number = epoch * steps + part
            some = pairs if steps == 1 else pairs.where(dealt == part)
            loss, n, found, below = gradients(features, edges, some, layers, config.batch_size, fanout, config.seed + epoch, scale)
            discard(below)
            total_loss, seen = total_loss + loss, seen + n
            if not n:
                continue
            length = math.sqrt(sum((g * g).sum() for own in found for g in own.values())) / n
            mean, rate = 1.0 / n / max(1.0, length / config.max_grad_norm), learning_rate(number, config.epochs * steps, config.learning_rate)
            after = []
            for layer, own, m in zip(layers, found, moments, strict=True):
                moved = {}
                for k, v in parameters(layer).items():
                    if config.optimizer == "adamw":
                        moved[k], *both = _adamw_step(v, own[k] * mean, *m[k], rate, number + 1, config)
                        m[k] = np.stack(both)
                    else:
                        moved[k] = v - rate * own[k] * mean
                after.append(replace(layer, **moved))
            layers = after
        if any([c.after_epoch(epoch, {"loss": total_loss / max(1, seen)}, layers) for c in callbacks]):
            break
    return layers


def save_layers(spark: SparkSession, layers: list[Layer], path: str) -> None:
    """(layer, kind, name, shape, data, setting) as Parquet: a row for each array of the model."""
    names = {kind: name for name, kind in KINDS.items()}
    rows = []
    for i, layer in enumerate(layers):
        setting = str(layer.pool) if isinstance(layer, Message) else "relu" if isinstance(layer, Dense) and layer.relu else ""
        rows += [(i, names[type(layer)], k, list(v.shape), v.ravel().tolist(), setting) for k, v in parameters(layer).items()]
    spark.createDataFrame(rows, "layer int, kind string, name string, shape array<int>, data array<double>, setting string").coalesce(1).write.mode("overwrite").parquet(path)


def load_layers(spark: SparkSession, path: str) -> list[Layer]:
    found: dict[int, tuple[str, str, dict]] = {}
    for r in spark.read.parquet(path).collect():  # the model's arrays
        found.setdefault(r["layer"], (r["kind"], r["setting"], {}))[2][r["name"]] = np.array(r["data"]).reshape(r["shape"])
    extra = {"dense": lambda s: {"relu": s == "relu"}, "message": lambda s: {"pool": s}, "attend": lambda s: {}}
    return [KINDS[kind](**values, **extra[kind](setting)) for _, (kind, setting, values) in sorted(found.items())]
