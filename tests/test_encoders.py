"""Encoders forward and backward against plain numpy and differences, neighbour sampling, training."""

from dataclasses import replace

import numpy as np
import pytest

from lightgraph.operators import encoders as en
from lightgraph.operators import kge
from lightgraph.params import TrainConfig

N, SIZE, DIM, HEADS = 7, 3, 4, 2
ENDS = [(0, 1, 0), (2, 1, 3), (1, 4, 3), (4, 0, 15), (0, 4, 2), (0, 1, 0), (6, 2, 5)]  # a repeated edge, nodes without any
PAIRS = [(0, 1), (1, 4), (2, 0), (4, 2), (0, 4), (5, 0)]


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((N, SIZE))
    features = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node_id long, embedding array<double>")
    edges = spark.createDataFrame([(s, d, i, b) for i, (s, d, b) in enumerate(ENDS)], "src long, dst long, pos int, bin int")
    pairs = spark.createDataFrame(PAIRS, "query long, document long")
    line = lambda a, b: (rng.standard_normal((a, b)), rng.standard_normal(b))
    layers = [
        en.Dense(*line(SIZE, DIM), relu=True), en.Message(rng.standard_normal((16, DIM, DIM)), rng.standard_normal(DIM)), en.Attend(*line(DIM, 3 * DIM), *line(DIM, DIM), rng.standard_normal((16, HEADS))),
        en.Message(rng.standard_normal((16, DIM, DIM)), rng.standard_normal(DIM), "sum"), en.Dense(*line(DIM, 5)),
    ]
    return x, features, edges, pairs, layers


def plain_norm(v):
    return (v - v.mean(1)[:, None]) / np.sqrt(v.var(1)[:, None] + 1e-5)


def plain(x, layers, ends=ENDS):
    h = x
    for la in layers:
        if isinstance(la, en.Dense):
            h = h @ la.weight + la.bias
            h = np.maximum(h, 0) if la.relu else h
            continue
        arrived = np.zeros_like(h)
        if isinstance(la, en.Message):
            for s, d, b in ends:
                arrived[d] += h[s] @ la.weights[b]
            if la.pool == "mean":
                arrived /= np.array([sum(d == i for _, d, _ in ends) for i in range(len(h))])[:, None] + 1e-8
            h = plain_norm(h + arrived + la.bias)
            continue
        q, k, v = np.split(h @ la.qkv + la.qkv_bias, 3, axis=1)
        for head in range(HEADS):
            part = slice(head * DIM // HEADS, (head + 1) * DIM // HEADS)
            e = np.exp([q[d, part] @ k[s, part] / np.sqrt(DIM // HEADS) + la.bin_bias[b, head] for s, d, b in ends])
            for (s, d, _), w in zip(ends, e / e.sum(), strict=True):
                arrived[d, part] += w * v[s, part]
        h = plain_norm(h + arrived @ la.out + la.out_bias)
    return h


def plain_loss(x, layers, pairs=PAIRS):
    h = plain(x, layers)
    u = h / np.linalg.norm(h, axis=1)[:, None]
    logits = 20 * u[[q for q, _ in pairs]] @ u[[d for _, d in pairs]].T
    return (np.log(np.exp(logits).sum(1)) - np.diag(logits)).sum()


def test_forward_equals_numpy(spark, world):
    x, features, edges, _, layers = world
    got = {r.node_id: np.array(r.embedding) for r in en.encode(features, edges, layers).collect()}
    want = plain(x, layers)
    want /= np.linalg.norm(want, axis=1)[:, None]
    assert len(got) == N and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in range(N))


def test_forward_equals_the_inference_layers(spark, world):
    _, features, edges, _, layers = world
    inward, _, at, _, outward = layers
    attention = kge.Attention(*((at.qkv[:, i * DIM : (i + 1) * DIM], at.qkv_bias[i * DIM : (i + 1) * DIM]) for i in range(3)), (at.out, at.out_bias), at.bin_bias)
    want = {r.node_id: r.embedding for r in kge.encode_with_attention(features, edges, (inward.weight, inward.bias), [attention], (outward.weight, outward.bias)).collect()}
    got = {r.node_id: r.embedding for r in en.encode(features, edges, [inward, at, outward]).collect()}
    assert len(got) == N and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in range(N))


def test_gradients_equal_differences(spark, world):
    """Every layer's parameters and the features, by central differences of the plain loss."""
    x, features, edges, pairs, layers = world
    loss, n, found, below = en.gradients(features, edges, pairs, layers)
    assert n == len(PAIRS) and loss == pytest.approx(plain_loss(x, layers), rel=1e-9)
    rng, h = np.random.default_rng(12), 1e-5
    for i, layer in enumerate(layers):
        for name, value in en.parameters(layer).items():
            assert found[i][name].shape == value.shape
            used = np.argwhere(np.abs(found[i][name]) > 0) if value.ndim == 3 else np.argwhere(np.ones(value.shape))
            for at in (tuple(a) for a in used[rng.permutation(len(used))[:6]]):
                moved = []
                for d in (h, -h):
                    other = value.copy()
                    other[at] += d
                    moved.append(plain_loss(x, [*layers[:i], replace(layer, **{name: other}), *layers[i + 1 :]]))
                assert found[i][name][at] == pytest.approx((moved[0] - moved[1]) / 2 / h, rel=1e-4, abs=1e-5), (i, name, at)
    got = {r.node_id: r.g for r in below.collect()}
    for node in range(N):
        for j in range(SIZE):
            up, down = x.copy(), x.copy()
            up[node, j] += h
            down[node, j] -= h
            assert got.get(node, [0.0] * SIZE)[j] == pytest.approx((plain_loss(up, layers) - plain_loss(down, layers)) / 2 / h, rel=1e-4, abs=1e-5)


def test_bins_without_edges_have_no_gradient(spark, world):
    _, features, edges, pairs, layers = world
    _, _, found, _ = en.gradients(features, edges, pairs, layers)
    unused = sorted(set(range(16)) - {b for _, _, b in ENDS})
    assert not found[1]["weights"][unused].any() and not found[2]["bin_bias"][unused].any()


def test_neighbour_sampling(spark):
    """A hub has `fanout` of its edges, the same for the same seed; other seeds take others; nodes of no use are not read."""
    edges = spark.createDataFrame([(i, 0, i, i % 16) for i in range(1, 101)] + [(200, 1, 0, 0), (300, 301, 0, 0)], "src long, dst long, pos int, bin int")
    layers = [en.Message(np.zeros((16, 2, 2)), np.zeros(2))] * 2
    wanted = spark.createDataFrame([(0,), (0,)], "node_id long")
    picks = []
    for seed in (1, 1, 2):
        levels = en.neighbourhoods(edges, wanted, layers, 5, seed)
        into = levels[1][1].collect()
        assert [r.node_id for r in levels[1][0].collect()] == [0] and len(into) == 5
        assert {r.node_id for r in levels[0][0].collect()} == {0} | {r.src for r in into}
        picks.append({r.src for r in into})
        assert not {300, 301} & {r.src for r in levels[0][1].collect()}
    assert picks[0] == picks[1] != picks[2]
    assert en.neighbourhoods(edges, wanted, layers, 0, 1)[1][1].count() == 100
    assert "WindowGroupLimit" in _plan(spark, edges, wanted)


def _plan(spark, edges, wanted):
    """The plan of the ranking that a sample is: filtered before it is shuffled."""
    seen = []
    real, en.materialize = en.materialize, lambda df, name: seen.append((name, df)) or df
    try:
        en.neighbourhoods(edges, wanted, [en.Message(np.zeros((16, 2, 2)), np.zeros(2))], 5, 1)
    finally:
        en.materialize = real
    return next(df for name, df in seen if name == "encoder-edges")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("heads", [0, 2])
def test_training_lowers_the_loss(spark, tmp_path, heads):
    rng = np.random.default_rng(13)
    n = 24
    features = spark.createDataFrame([(i, v) for i, v in enumerate(rng.standard_normal((n, 6)).tolist())], "node_id long, embedding array<double>")
    edges = spark.createDataFrame([(i, (i + 1) % n, 0, i % 3) for i in range(n)], "src long, dst long, pos int, bin int")
    pairs = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)] + [(0, 1), (3, 99)], "query long, document long")  # a repeated pair, an unknown node
    history = kge.History()
    config = TrainConfig(epochs=6, learning_rate=0.05, batch_size=64, optimizer="adamw")
    layers = en.train_encoder(features, edges, pairs, en.initial_layers((6, 8, 4), 1, heads), config, [history], fanout=4)
    losses = [r["loss"] for r in history.rows]
    assert len(losses) == 6 and losses[-1] < 0.8 * losses[0]
    en.save_layers(spark, layers, str(tmp_path / "model"))
    for a, b in zip(layers, en.load_layers(spark, str(tmp_path / "model")), strict=True):
        assert type(a) is type(b) and all((v == en.parameters(b)[k]).all() for k, v in en.parameters(a).items())
    assert [la.relu for la in layers if isinstance(la, en.Dense)] == [la.relu for la in en.load_layers(spark, str(tmp_path / "model")) if isinstance(la, en.Dense)]


def test_text_head(spark):
    """A head over text vectors needs no edges; steps without pairs change nothing."""
    texts = spark.createDataFrame([(str(i), w) for i, w in enumerate(["red rose", "rose red garden", "blue sea", "sea blue wave", "old stone", "stone wall old"])], "document_id string, text string")
    vectors = kge.hashed_sentences(texts, 16).select(kge.F.col("document_id").cast("long").alias("node_id"), "embedding")
    pairs = spark.createDataFrame([(0, 1), (2, 3), (4, 5)], "query long, document long")
    history = kge.History()
    start = [en.Dense(np.random.default_rng(1).standard_normal((16, 4)) / 4, np.zeros(4))]
    head = en.train_encoder(vectors, None, pairs, start, TrainConfig(epochs=5, learning_rate=0.1), [history])
    assert history.rows[-1]["loss"] < history.rows[0]["loss"]
    assert en.encode(vectors, None, head).count() == 6
    same = en.train_encoder(vectors, None, pairs.limit(0), start, TrainConfig(epochs=1))
    assert (same[0].weight == start[0].weight).all()
    with pytest.raises(ValueError):
        en.train_encoder(vectors, None, pairs, start, TrainConfig(optimizer="none"))
