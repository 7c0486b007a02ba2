import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lightgraph.llm import packing, queries
from lightgraph.session import materialize

from .helpers import documents, empty_documents, odd_documents, odd_rows

HF = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts, room=2048):
    """Every document's pieces in order and whole, every sequence full without gaps or overlaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = [*HF.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for n, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and 0 < r.length <= room
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert n == 0 or r.length == room
            at += r.length
        assert at == len(ids) and (len(ids) > room or len(by_doc[i]) == 1)
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= room
    return len(by_sequence)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    rows = queries.op6_grouping_genetic_packing(spark, sf).collect()
    n = check(rows, texts)
    least = -(-sum(r.length for r in rows) // 2048)
    assert n <= least * 1.01 + 1


def test_islands(spark):
    """Many islands, with migration and pooled releases, come near one island."""
    sf = "/root/testdata/sf0.01"
    docs = documents(spark, sf)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.sequences(docs, island=150).collect()
    least = -(-sum(r.length for r in rows) // 2048)
    assert check(rows, texts) <= least * 1.02 + 2


@pytest.mark.parametrize("island", [1, 2, 4])
def test_islands_without_pieces(spark, island):
    """Of so many tiny islands some are empty; no piece is lost."""
    table = materialize(spark.range(40).selectExpr("id as uid", "id * 37 % 2000 + 1 as length"), "pieces")
    rows = packing.pack(table, island=island).collect()
    assert sorted(r.uid for r in rows) == list(range(40))
    lengths, fill = {r.uid: r.length for r in table.collect()}, defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, lengths[r.uid]))
    for some in fill.values():
        assert [o for o, _ in sorted(some)] == [sum(n for o, n in some if o < p) for p, _ in sorted(some)] and sum(n for _, n in some) <= 2048


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = packing.sequences(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    check(rows, {i: t for i, t, *_ in odd_rows() if i is not None})
    every = packing.sequences(docs)
    assert every.groupBy("sequence_id", "offset").count().where("count > 1").count() == 0
    assert every.where("piece = 0").count() == docs.count()  # repeated rows are packed each
    assert packing.sequences(empty_documents(spark)).count() == 0


def solved(lengths, rng):
    return packing.begin(lengths, 2048, rng, 3)


def test_children_are_packings():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2048, 400)
    parents = solved(lengths, rng)
    for _ in range(20):
        wanted = packing.patterns(lengths, parents[1], rng.permutation(len(parents[1].fill))[:40])
        child = packing.inject(lengths, parents[0], [*wanted, (2047, 2047)], 2048, rng)
        assert (np.bincount(child.bin_of, weights=lengths) == child.fill).all() and child.fill.max() <= 2048 and child.fill.min() > 0


def test_evolution_beats_best_fit():
    """Triplets that fill bins exactly, which best fit misses."""
    rng = np.random.default_rng(8)
    a, b = rng.integers(520, 700, 60), rng.integers(520, 700, 60)
    lengths = np.concatenate([a, b, 2048 - a - b])
    first = packing.best_fit(lengths, np.zeros(180, np.int64), [], packing.descending(lengths, np.arange(180), 0, rng), 2048)
    best = packing.evolve(lengths, solved(lengths, rng), [], 2048, rng, 400)[0]
    assert 60 <= len(best.fill) <= len(first.fill) and best.rank < first.rank


def test_immigrants_are_injected():
    lengths = np.array([1000, 1048, 1000, 1048, 900, 900])
    bad = packing.Packing(np.array([0, 1, 0, 2, 1, 2]), np.array([2000, 1948, 1948]))
    child = packing.inject(lengths, bad, [(1048, 1000), (1048, 1000)], 2048, np.random.default_rng(0), mutate=0)
    assert sorted(child.fill.tolist()) == [1800, 2048, 2048]
