import math

import numpy as np
import pytest

from lightgraph.operators import kge, vectors


def frame(spark, rows):
    return spark.createDataFrame(rows, "node_id long, embedding array<double>")


def test_top_k(spark):
    s = vectors.store(frame(spark, [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0])]))
    assert [r.node_id for r in vectors.top_k_similar(s, [1.0, 0.0], 2).collect()] == [0, 1]
    assert vectors.top_k_similar(s, [0.0, 0.0], 2).count() == 0 and vectors.top_k_similar(s, [1.0, 0.0], 10).count() == 4
    assert {r.node_id: r.similarity for r in vectors.all_similarities(s, [2.0, 0.0]).collect()}[4] == 0.0


def test_updates(spark):
    s = vectors.store(frame(spark, [(0, [1.0, 0.0]), (1, [3.0, 4.0])]))
    up = frame(spark, [(0, [0.0, 2.0]), (1, [1.0]), (9, [1.0, 1.0])])
    assert {r.node_id: (r.embedding, r.norm) for r in vectors.set_embeddings(s, up, 2).collect()} == {0: ([0.0, 2.0], 2.0), 1: ([3.0, 4.0], 5.0)}


def test_statistics(spark):
    r = vectors.statistics(frame(spark, [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0])])).collect()[0]
    assert (r.num_rows, r.dim, r.num_zero, r.num_not_normalized, r.max_norm, r.min_norm) == (3, 2, 1, 2, 5.0, 0.0)
    assert r.std_value == pytest.approx(np.std([3, 4, 0, 0, 1, 0]))
    assert vectors.is_valid(frame(spark, [(0, [1.0])])) and not vectors.is_valid(frame(spark, [(0, [math.nan])])) and not vectors.is_valid(frame(spark, [(0, [math.inf])]))


def test_blocks_cover_all_pairs(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((50, 4))
    df = frame(spark, [(i, x.tolist()) for i, x in enumerate(v)])
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = n @ n.T
    got = {(r.a, r.b): r.similarity for r in vectors.similarity_matrix(df, df).collect()}
    assert len(got) == 2500 and all(got[i, j] == pytest.approx(s[i, j]) for i in range(50) for j in range(50))
    np.fill_diagonal(s, -9)
    for r in vectors.knn_edges(df, 3).collect():
        assert r.dst == np.argsort(-s[r.src])[r.pos]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_matrix_of_many_blocks_is_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    v = np.random.default_rng(3).standard_normal((90, 4))
    v[7] = 0
    df = frame(spark, [(i, x.tolist()) for i, x in enumerate(v)])
    got = vectors.similarity_matrix(df, df.where("node_id < 40"))
    assert shuffles(got) == 0
    n = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)
    found = {(r.a, r.b): r.similarity for r in got.collect()}
    assert len(found) == 90 * 40 and all(found[i, j] == pytest.approx(n[i] @ n[j]) for i in range(90) for j in range(40))


def test_matrix_comes_in_order_of_similarity(spark, monkeypatch):
    """Equal values follow each other, so that the written result is small: in each stretch of ORDERED pairs, of which one has a rest of the left rows."""
    monkeypatch.setattr(vectors, "ORDERED", 40 * 32)
    v = np.random.default_rng(5).standard_normal((90, 2))
    v[7], v[8, 1], v[20:40] = 0, np.nan, v[20]
    df = frame(spark, [(i, x.tolist()) for i, x in enumerate(v)])
    rows = vectors.similarity_matrix(df, df.where("node_id < 40")).collect()
    for n in range(0, 90 * 40, 40 * 32):
        part = rows[n : n + 40 * 32]
        assert len({r.a for r in part}) == min(32, 90 - n // 40)
        places = [math.inf if math.isnan(r.similarity) else round(r.similarity, 6) for r in part]
        assert places == sorted(places)
    n = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)
    found = {(r.a, r.b): r.similarity for r in rows}
    assert len(rows) == len(found) == 90 * 40 and all(found[i, j] == pytest.approx(n[i] @ n[j], abs=1e-12, nan_ok=True) for i in range(90) for j in range(40))


def test_places_in_order():
    s = np.array([0.5, np.nan, -1.0, 0.1234564, 1.0, 0.1234561, -0.0, 0.0])
    assert vectors._in_order(s).tolist() == [2, 6, 7, 3, 5, 0, 4, 1]
    s = np.random.default_rng(6).uniform(-1, 1, vectors.SLICE + 9)
    assert (vectors._in_order(s) == np.lexsort((np.arange(len(s)), np.rint(s * 1e6)))).all()


def test_nearest_of_many_blocks(spark, monkeypatch):
    """Copies, vectors without length or not finite, an id with two vectors; only the nearest are shuffled."""
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(4)
    v = rng.standard_normal((300, 6))
    v[100:160], v[200], v[201, 2] = v[100], 0, np.nan
    ids = np.arange(300)
    ids[299] = 298
    got = vectors.knn_edges(frame(spark, [(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)]), 3)
    assert shuffles(got) == 1
    n = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)
    s = np.where(ids[:, None] == ids[None], -np.inf, n @ n.T)
    found = {(r.src, r.pos): (r.dst, r.similarity) for r in got.collect()}
    assert len(found) == 298 * 3  # 299 ids, of which one has no finite vector
    for i in range(298):
        if i != 201:
            row = np.where(np.isnan(s[i]), -np.inf, s[i])
            for pos, j in enumerate(np.lexsort((ids, -row.round(9)))[:3]):
                assert found[i, pos][0] == ids[j] and found[i, pos][1] == pytest.approx(row[j], abs=1e-12)


def test_rotation(spark):
    phases = [[0.1 * b, -0.2 * b] for b in range(16)]
    e = frame(spark, [(0, [1.0, 2.0, 3.0, 4.0]), (1, [0.5, 0.5, 0.5, 0.5])])
    t = spark.createDataFrame([(0, 3, 1), (1, 0, 1)], "head_id long, angle_bin int, tail_id long")
    got = {(r.head_id, r.angle_bin): r.distance for r in kge.scored(t, e, phases).collect()}
    z = np.array([1 + 3j, 2 + 4j]) * np.exp(1j * np.array(phases[3]))
    assert got[0, 3] == pytest.approx(np.sqrt(abs(z - (0.5 + 0.5j)) ** 2 + 1e-8).sum()) and got[1, 0] == pytest.approx(2e-4, abs=1e-6)


def test_ranks(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((30, 4))
    e = frame(spark, [(i, x.tolist()) for i, x in enumerate(v)])
    phases = kge.initial_phases(4)
    t = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, 30, 20), rng.integers(0, 16, 20), rng.integers(0, 30, 20), strict=True)]
    triples = spark.createDataFrame(t, "head_id long, angle_bin int, tail_id long")
    c = v[:, :2] + 1j * v[:, 2:]

    def rank(h, b, tail, skip=()):
        d = np.sqrt(abs(c[h] * np.exp(1j * np.array(phases[b])) - c) ** 2 + 1e-8).sum(1)
        return 1 + sum(d[i] < d[tail] - 1e-12 for i in range(30) if i != tail and i not in skip)

    for filtered in (None, triples):
        got = {(r.head_id, r.angle_bin, r.tail_id): r["rank"] for r in kge.link_ranks(triples, e, phases, filtered).collect()}
        assert got == {x: rank(*x, skip={k for h, b, k in t if (h, b) == x[:2]} if filtered is not None else ()) for x in set(t)}


def test_training_lowers_the_loss(spark, tmp_path):
    from lightgraph.params import TrainConfig

    t = spark.createDataFrame([(i, i % 3, (i + 1) % 12) for i in range(12)], "head_id long, angle_bin int, tail_id long")
    history = kge.History()
    model = kge.train_rotation(t, 12, TrainConfig(dim=8, epochs=6, learning_rate=0.5, negatives=2), [history, kge.EarlyStop(5), kge.Checkpoint(str(tmp_path), 3)])
    losses = [r["loss"] for r in history.rows]
    assert min(losses[1:]) < losses[0] and model[0].count() == 12
    entities, phases = kge.load_model(spark, f"{tmp_path}/epoch-0003")
    assert entities.count() == 12 and len(phases) == 16
    stop = kge.EarlyStop(2)
    assert [stop.after_epoch(i, {"loss": 1.0}, None) for i in range(3)] == [False, False, True]


def test_training_with_moments(spark):
    from lightgraph.params import TrainConfig

    t = spark.createDataFrame([(i, i % 3, (i + 1) % 12) for i in range(12)], "head_id long, angle_bin int, tail_id long")
    history = kge.History()
    entities, phases = kge.train_rotation(t, 13, TrainConfig(dim=8, epochs=3, learning_rate=0.1, negatives=2, optimizer="adamw", steps_per_epoch=2), [history])
    losses = [r["loss"] for r in history.rows]
    assert losses[-1] < losses[0] and entities.columns == ["node_id", "embedding"] and entities.count() == 13 and len(phases) == 16
    with pytest.raises(ValueError):
        kge.train_rotation(t, 13, TrainConfig(optimizer="none"))


def test_moments_of_entities(spark):
    from lightgraph.params import TrainConfig

    rng, config = np.random.default_rng(2), TrainConfig(dim=4)
    v, g, first, second = rng.standard_normal((4, 3, 4))
    second = second**2
    rows = [(i, v[i].tolist(), first[i].tolist(), second[i].tolist(), g[i].tolist() if i else None) for i in range(3)]
    got = kge._adamw(spark.createDataFrame(rows, "node_id long, embedding array<double>, first array<double>, second array<double>, g array<double>"), 0.5, 0.1, 3, config)
    g[0] = 0  # an entity of no triple
    expected = kge._adamw_step(v, g * 0.5, first, second, 0.1, 3, config)
    for r in got.collect():
        for have, want in zip((r.embedding, r.first, r.second), expected, strict=True):
            assert have == pytest.approx(want[r.node_id], abs=1e-12)
    m, s = 0.9 * first + 0.1 * g * 0.5, 0.999 * second + 0.001 * (g * 0.5) ** 2
    assert expected[0] == pytest.approx(v * (1 - 0.1 * 0.01) - 0.1 * (m / (1 - 0.9**3)) / (np.sqrt(s / (1 - 0.999**3)) + 1e-8), abs=1e-12)


def test_graph_encoder(spark):
    rng = np.random.default_rng(3)
    x = frame(spark, [(i, rng.standard_normal(4).tolist()) for i in range(6)])
    edges = spark.createDataFrame([(i, (i + 1) % 5, 0, i % 16) for i in range(5)] + [(0, 2, 1, 3)], "src long, dst long, pos int, bin int")
    w, b = rng.standard_normal((16, 4, 4)), rng.standard_normal(4)
    v = {r.node_id: np.array(r.embedding) for r in x.collect()}
    got = {r.node_id: np.array(r.embedding) for r in kge.encode_graph(x, edges, [(w, b)]).collect()}
    for i in range(6):
        into = [v[r.src] @ w[r.bin] for r in edges.collect() if r.dst == i]
        y = v[i] + (np.sum(into, axis=0) / (len(into) + 1e-8) if into else 0) + b
        y = (y - y.mean()) / np.sqrt(y.var() + 1e-5)
        assert got[i] == pytest.approx(y / np.linalg.norm(y), abs=1e-9)
    a = kge.edge_attention(edges, x, w[:, 0].tolist()).collect()
    assert sum(r.weight for r in a) == pytest.approx(1)


def test_attention_encoder(spark):
    from lightgraph.session import materialize

    rng = np.random.default_rng(4)
    n, size, dim, heads = 7, 3, 4, 2
    x = rng.standard_normal((n, size))
    features = frame(spark, [(i, x[i].tolist()) for i in range(n)])
    ends = [(0, 1, 0), (2, 1, 3), (1, 4, 3), (4, 0, 15), (0, 4, 2), (0, 1, 0)]  # a repeated edge, nodes without any
    edges = materialize(spark.createDataFrame([(s, d, i, b) for i, (s, d, b) in enumerate(ends)], "src long, dst long, pos int, bin int"), "test-edges")
    line = lambda a, b: (rng.standard_normal((a, b)), rng.standard_normal(b))
    inward, outward = line(size, dim), line(dim, 5)
    layers = [kge.Attention(*(line(dim, dim) for _ in range(4)), rng.standard_normal((16, heads))) for _ in range(2)]

    def expected(ends):
        h = np.maximum(x @ inward[0] + inward[1], 0)
        for la in layers:
            q, k, v = (h @ w + b for w, b in (la.query, la.key, la.value))
            arrived = np.zeros((n, dim))
            for head in range(heads):
                part = slice(head * 2, head * 2 + 2)
                e = np.exp([q[d, part] @ k[s, part] / np.sqrt(2) + la.bin_bias[b, head] for s, d, b in ends])
                for (s, d, _), w in zip(ends, e / e.sum(), strict=True):
                    arrived[d, part] += w * v[s, part]
            h = h + arrived @ la.out[0] + la.out[1]
            h = (h - h.mean(1)[:, None]) / np.sqrt(h.var(1)[:, None] + 1e-5)
        y = h @ outward[0] + outward[1]
        return y / np.linalg.norm(y, axis=1)[:, None]

    for table, of in ((edges, ends), (edges.limit(0), [])):
        got = {r.node_id: r.embedding for r in kge.encode_with_attention(features, table, inward, layers, outward).collect()}
        assert len(got) == n and all(got[i] == pytest.approx(expected(of)[i], abs=1e-9) for i in range(n))


def test_configs_and_recommendations():
    from lightgraph.params import Config, DataConfig, from_dict

    c = from_dict(Config, {"data": {"chunk_size": 9, "unknown": 1}, "evaluation": {"hits_k": (1, 5)}, "other": 3})
    assert c.data.chunk_size == 9 and c.data.chunk_overlap == 50 and c.evaluation.hits_k == (1, 5) and c.export.normalize and c.training.epochs == 10
    assert from_dict(DataConfig, {"seed": 7}).seed == 7 and from_dict(Config, {}) == Config()
    assert kge.recommended_encoder("code")[1] == 768 and kge.recommended_encoder("cooking") == kge.recommended_encoder()


def test_encoders(spark):
    texts = spark.createDataFrame([("a", "red green"), ("b", "green red"), ("c", "blue")], "document_id string, text string")
    v = {r.document_id: r.embedding for r in kge.hashed_sentences(texts, 32).collect()}
    assert v["a"] == v["b"] != v["c"] and np.linalg.norm(v["c"]) == pytest.approx(1)
    got = {r.document_id: r.embedding for r in kge.encode_with(texts, lambda: lambda ts: np.array([[len(t), 1.0] for t in ts])).collect()}
    assert got["c"] == [4.0, 1.0]
    got = {r.document_id: r.embedding for r in kge.encode_instructed(texts, "query", lambda: lambda ts: np.array([[len(said), len(t)] for said, t in ts])).collect()}
    assert got["c"] == [float(len(kge.INSTRUCTIONS["query"])), 4.0]
    e = spark.createDataFrame([(0, 1, [1.0, 0.0])], "node_id long, bin int, embedding array<double>")
    assert kge.projected(e, np.array([[0.0, 2.0], [1.0, 0.0]]), np.zeros(2)).collect()[0].embedding == [0.0, 1.0]
    assert kge.projected(e, np.stack([np.eye(2), np.array([[0.0, 2.0], [1.0, 0.0]])]), np.zeros(2)).collect()[0].embedding == [0.0, 1.0]


@pytest.mark.parametrize("pivots", [1, 16])
def test_link_ranks_skip_by_the_triangle_inequality(spark, monkeypatch, pivots):
    """Clustered entities: the ranks are those of all pairs, and most pairs are never compared."""
    rng = np.random.default_rng(5)
    n, dim = 400, 8
    x = np.repeat(rng.standard_normal((16, dim)) * 5, n // 16, axis=0) + rng.standard_normal((n, dim)) * 0.1
    phases = (rng.standard_normal((16, dim // 2)) * 0.02).tolist()
    tail = lambda h: int(h // 25 * 25 + rng.integers(25)) if rng.random() < 0.9 else int(rng.integers(n))  # noqa: E731  mostly of the head's own cluster
    rows = [(int(h), int(rng.integers(16)), tail(h)) for h in rng.integers(0, n, 300)]
    e = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node_id long, embedding array<double>")
    got = kge.link_ranks(spark.createDataFrame(rows, "head_id long, angle_bin int, tail_id long"), e, phases, pivots=pivots).collect()
    assert len(got) == len(set(rows))
    for r in got:
        phi = np.array(phases[r.angle_bin])
        head = (x[r.head_id, : dim // 2] + 1j * x[r.head_id, dim // 2 :]) * np.exp(1j * phi)
        gap = head - (x[:, : dim // 2] + 1j * x[:, dim // 2 :])
        d = np.sqrt(gap.real**2 + gap.imag**2 + 1e-8).sum(1)
        assert r["rank"] == 1 + (np.delete(d, r.tail_id) < d[r.tail_id] - 1e-12).sum()
    share = sum(r.compared for r in got) / len(got) / n
    assert share < 0.35 if pivots == 16 else share <= 1


def test_a_triple_is_written_once(spark, monkeypatch):
    """However many cells it has to meet; without structure these are all."""
    written = {}
    monkeypatch.setattr(kge, "materialize", lambda df, name, f=kge.materialize: written.setdefault(name, f(df, name)))
    rng = np.random.default_rng(6)
    e = spark.createDataFrame([(i, v) for i, v in enumerate(rng.standard_normal((300, 64)).tolist())], "node_id long, embedding array<double>")
    triples = spark.createDataFrame([(i, 0, (i * 7 + 1) % 300) for i in range(300)], "head_id long, angle_bin int, tail_id long")
    assert kge.link_ranks(triples, e, kge.initial_phases(64), pivots=8).count() == 300
    assert sum(len(r.turned) for r in written["links-open"].collect()) == 300 * 64 * 8


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e20])
def test_nearer_rows(scale):
    """Copies, near copies and a tail among them, against double precision alone."""
    rng = np.random.default_rng(7)
    y = rng.standard_normal((500, 8)) * scale
    y[100:150] = y[100]
    y[150:200] = y[100] + rng.standard_normal((50, 8)) * 1e-9 * scale
    x, node = np.concatenate([y[90:110], rng.standard_normal((20, 8)) * scale]), np.arange(500)
    tail = rng.integers(100, 600, len(x))
    gap = x[:, None] - y[None]
    d = np.sqrt(gap[..., :4] ** 2 + gap[..., 4:] ** 2 + 1e-8).sum(2)
    own = d[np.arange(len(x)), np.minimum(tail, 499)]
    expected = ((d < own[:, None] - 1e-12) & (node[None] != tail[:, None])).sum(1)
    longest = np.hypot(y[:, :4], y[:, 4:]).sum(1).max()
    assert (kge.nearer_rows(x, own, tail, y, node, kge.single_columns(y), longest) == expected).all()
