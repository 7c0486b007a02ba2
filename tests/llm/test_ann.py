import numpy as np
import pytest
from pyspark.sql import functions as F

from lightgraph.llm import ann, queries


def exact(vectors, k=10, step=100):
    """query -> its nearest ids, by brute force in double precision."""
    ids = np.array(sorted(vectors))
    v = np.stack([np.asarray(vectors[i], float) for i in ids])
    out = {}
    for n, i in enumerate(ids):
        if i % step == 0:
            d = np.sqrt(((v - v[n]) ** 2).sum(1))
            out[int(i)] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if j != n][:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got, expected = found(queries.op5_multi_index_hashing(spark, sf)), exact(vectors)
    assert set(got) == set(expected)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits / sum(map(len, expected.values())) >= 0.95
    for q, rows in got.items():
        assert rows == sorted(rows, key=lambda r: (r[1], r[0]))
        for i, s in rows:
            assert s == pytest.approx(np.sqrt(((np.array(vectors[i], float) - np.array(vectors[q], float)) ** 2).sum()), rel=1e-12)


def planted(n, seed):
    """Random codes, some of them a few bits from the first."""
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 2**63, (n, 4), dtype=np.int64).view(np.uint64)
    for at, some in enumerate((1, 5, 15, 16, 17, 30, 40, 59, 60, 61)):
        row = codes[0].copy()
        for b in rng.choice(256, some, replace=False):
            row[b // 64] ^= np.uint64(1 << int(b % 64))
        codes[at + 1] = row
    return codes


@pytest.mark.parametrize("radius", [0, 3, 15, 16, 17, 33, 47])
def test_probes_find_every_code_within_the_radius(spark, radius):
    codes = planted(5000, radius)
    subs = ann.substrings(len(codes))
    coded = spark.createDataFrame([(i, bytearray(c.tobytes())) for i, c in enumerate(codes)], "id long, code binary")
    asks = coded.where("id in (0, 1, 77)").selectExpr("id", "code", f"{radius} as radius")
    got = {(r.query, r.id) for r in ann.within(coded, asks, subs).collect()}
    assert got == {(q, int(i)) for q in (0, 1, 77) for i in np.flatnonzero(np.bitwise_count(codes ^ codes[q]).sum(1) <= radius)}


def test_substrings_cover_the_code():
    for n in (1, 300, 50_000, 10**9, 10**15):
        subs = ann.substrings(n)
        assert subs[0][0] == 0 and sum(b for _, b in subs) == 256 and all(a + b == c for (a, b), (c, _) in zip(subs, subs[1:]))
        codes = planted(50, 1)
        bits = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little").astype(np.int64)
        assert (ann.values(codes, subs) == np.stack([(bits[:, a : a + b] << np.arange(b)).sum(1) for a, b in subs], 1)).all()


def clusters(n, size, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n, dim))
    return np.repeat(centres, size, 0) + 0.05 * rng.standard_normal((n * size, dim))


def test_clustered_vectors_are_probed(spark):
    """Where neighbours are near, every query probes, few codes are met, and the recall holds."""
    v = clusters(400, 30, 64, 5)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    index = ann.entries(ann.able(df), 10).withColumn("id", F.monotonically_increasing_id())
    model, subs = ann.fit(index, 10), ann.substrings(len(v))
    some = v[::100]
    radius = model.radius(model.bound(some, np.ones(len(some), np.int64), 10)).astype(int)
    assert all(ann.probing(r, subs) for r in radius)
    met = [len({i for j, every in ann.probes(c, r, subs) for i in np.flatnonzero(np.isin(ann.values(model.codes(v), subs)[:, j], every)).tolist()}) for c, r in zip(model.codes(some)[:20], radius[:20])]
    assert max(met) < 0.05 * len(v)
    got, expected = found(ann.search(df, F.col("vec_id") % 100 == 0)), exact(dict(enumerate(v)))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert set(got) == set(expected) and hits / sum(map(len, expected.values())) >= 0.9


def test_probed_and_checked_queries_alike(spark, monkeypatch):
    """Both ways retrieve the same rows, radii being equal."""
    v = clusters(40, 30, 16, 6)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = []
    for most in (ann.PROBES, -1):
        monkeypatch.setattr(ann.probing, "__code__", (lambda radius, subs: True).__code__ if most > 0 else (lambda radius, subs: False).__code__)
        monkeypatch.setattr(ann.Model, "radius", lambda self, distance: np.full(len(distance), 20))
        got.append({(r.query_id, r.vec_id, round(r.score, 9)) for r in ann.search(df, F.col("vec_id") % 100 == 0).collect()})
    assert got[0] == got[1] and got[0]


def test_radii_that_are_too_small_grow(spark, monkeypatch):
    """With a radius of two bits hardly any query would find ten; all of them do, and the same as by brute force."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((700, 32))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann.Model, "radius", lambda self, distance: np.full(len(distance), 2))
    got, expected = found(ann.search(df, F.col("vec_id") % 100 == 0)), exact(dict(enumerate(v)))
    assert {q: [i for i, _ in rows] for q, rows in got.items()} == {q: [i for i, _ in rows] for q, rows in expected.items()}


def test_a_bound_between_near_and_far_pairs():
    model = ann.Model(np.zeros(2), np.eye(2), np.array([0.1, 0.2, 1.0, 1.2]), np.array([5, 7, 100, 110]), np.zeros((0, 2)), np.zeros(0))
    assert model.radius(np.array([0.0, 0.05, 0.2, 0.21, 0.95, 1.2, 1.3])).tolist() == [0, 5, 7, 9, 95, 110, 256]


def test_lengths_have_their_own_neighbours(spark):
    rows = [(i, [float(i), 1.0]) for i in range(0, 30)] + [(i, [1.0, float(i), 2.0]) for i in range(100, 130)] + [(200, [1.0] * 4)]
    got = found(ann.search(frame(spark, rows), F.col("vec_id") % 100 == 0))
    assert [i for i, _ in got[0]] == list(range(1, 11)) and [i for i, _ in got[100]] == list(range(101, 111)) and 200 not in got


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, id string")


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 400)]  # a large group of copies
    rows += [(1000 + i, rng.standard_normal(3).round(1).tolist()) for i in range(300)]
    fine = {i: v for i, v in rows if any(v)}
    odd = [(2000, None), (2100, [0.0, 0.0, 0.0]), (2200, [1.0, None, 0.0]), (2300, [float("nan"), 1.0, 1.0]), (2400, [float("inf"), 1.0, 1.0]), (2500, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), rows[0], rows[7]]
    got, expected = found(ann.search(frame(spark, rows + odd), F.col("vec_id") % 100 == 0)), exact(fine)
    assert set(got) == set(expected)
    for q in (0, 100, 200, 300):
        assert got[q] == expected[q]
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits / sum(map(len, expected.values())) >= 0.9


def test_few_and_none(spark):
    got = found(ann.search(frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [1.0, 2.25])]), F.col("vec_id") % 100 == 0))
    assert got == {0: [(2, 0.25), (1, 0.5)]}
    assert ann.search(frame(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0


def test_two_vectors_of_one_id(spark):
    got = ann.search(frame(spark, [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (5, [1.0, 0.1]), (6, [0.1, 1.0])]), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == [(0, 1, 5, 0.1), (0, 2, 6, 0.1)]


def test_an_id_with_many_vectors_is_one_candidate_and_one_query(spark):
    """Id 0 asks with six vectors, ids 1 and 2 have forty near ones; each query has k distinct others, by their nearest vectors."""
    rng = np.random.default_rng(4)
    rows = [(0, rng.standard_normal(6) * 0.1) for _ in range(6)] + [(1 + i % 2, rng.standard_normal(6) * 0.1) for i in range(80)] + [(10 + i, rng.standard_normal(6) * (1 + i % 3)) for i in range(60)] + [(100, rng.standard_normal(6))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(df, F.col("vec_id") % 100 == 0, 10).collect())
    expected = []
    for q in (0, 100):
        near = {}
        for i, v in rows:
            if i != q:
                d = min(float(np.sqrt(((v - w) ** 2).sum())) for j, w in rows if j == q)
                near[i] = min(near.get(i, d), d)
        expected += [(q, n + 1, i, round(d, 9)) for n, (i, d) in enumerate(sorted(near.items(), key=lambda x: (x[1], x[0]))[:10])]
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert [g[3] for g in got] == pytest.approx([e[3] for e in expected])
