import numpy as np
import pytest
import xxhash

from lightgraph.llm import queries, simhash
from lightgraph.llm.components import components

from .helpers import LOWER, documents, empty_documents, odd_documents, odd_rows, words


def brute_print(text):
    w = words((text or "").translate(LOWER))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """(fingerprint, smallest reachable id) of each row (doc_id, text), by repeated sweeps."""
    prints = np.array([brute_print(t) for _, t in rows], np.uint64)
    label = np.array([i if i is not None else 2**62 for i, _ in rows])
    while True:
        new = np.array([min(label[np.bitwise_count(prints ^ p) <= 3]) for p in prints])
        if (new == label).all():
            return [(f"{p:016x}", None if x == 2**62 else int(x)) for p, x in zip(prints.tolist(), label, strict=True)]
        label = new


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp long, component_id long")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted(((i is None, i or 0, *c) for (i, _), c in zip(rows, brute_components(rows), strict=True)), key=str)


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    expected = {i: c for (i, _), c in zip(rows, brute_components(rows), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash_near_dedup(spark, sf).collect()}
    assert got == expected


def test_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(i, base.replace(f"w{i * 7} ", f"v{i} ")) for i in range(40)] + [(100 + i, base) for i in range(20)] + [(200 + i, f"short {i % 3} text") for i in range(12)]
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, [(i, t) for i, t, *_ in odd_rows()])
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0


def linked(prints, tile=simhash.TILE):
    prints = np.array(sorted(set(prints)), np.uint64)
    label = np.arange(len(prints))
    while True:
        new = np.array([label[np.bitwise_count(prints ^ p) <= 3].min() for p in prints])
        if (new == label).all():
            return {int(p.view(np.int64)): int(prints[x].view(np.int64)) for p, x in zip(prints, label, strict=True)}
        label = new


@pytest.mark.parametrize("hot", [False, True])
def test_links_of_crowded_tiles(spark, monkeypatch, hot):
    """Chains and clouds of near fingerprints, in whole tiles and in chunks."""
    if hot:
        monkeypatch.setattr(simhash, "HOT", 40)
        monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "SQUARE", 32)
    rng = np.random.default_rng(9)
    prints, at = [], int(rng.integers(0, 2**63))
    for _ in range(60):  # a chain whose ends are far apart
        at ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
        prints.append(at)
    for _ in range(150):  # a cloud
        prints.append(prints[0] ^ 1 << int(rng.integers(64)) ^ 1 << int(rng.integers(64)))
    prints += [int(x) for x in rng.integers(0, 2**63, 300)]
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in set(prints)], "fp long")
    edges = simhash.links(df, df.count())
    assert edges.count() <= 4 * 3 * df.count()  # forests, not pairs
    root = {r.node: r.root for r in components(edges).collect()}
    expected = linked(prints)
    groups = lambda m: sorted(sorted(k for k in expected if m(k) == g) for g in {m(k) for k in expected})
    assert groups(lambda k: root.get(k, k)) == groups(expected.get)


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (3, 4), (4, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_first_of_each(spark):
    docs = odd_documents(spark)
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    rows = [(i, t) for i, t, *_ in odd_rows()]
    expected = {c for _, c in brute_components(rows)}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert simhash.first_of_each(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("n", [100, 20_000, 1 << 27, 1 << 40])
def test_no_table_of_tiles_loses_a_link(spark, n):
    """One tile, tiles by few and by all bits of a lane, and tiles by two lanes of five."""
    rng = np.random.default_rng(n % 1000)
    prints = rng.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64)
    near = [p ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))) for p in prints]
    every = np.unique(np.concatenate([prints, np.array(near, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df, n)).collect()}
    expected = linked(every)
    groups = lambda of: {frozenset(k for k in of if of[k] == r) for r in set(of.values())}
    alone = {int(x) for x in every.view(np.int64)} - set(got)
    assert groups(got | {x: x for x in alone}) == groups(expected)
