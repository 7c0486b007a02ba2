import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from lightgraph.llm import brown, queries

from .helpers import LOWER, documents, empty_documents, fold, odd_documents, odd_rows, words


def check(rows, texts):
    tokens = {i: words((t or "").translate(LOWER)) for i, t in texts.items()}
    train = [i for i in tokens if fold(i, 7) != 2]
    count = Counter(w for i in train for w in tokens[i])
    n, v = sum(count.values()) + len(train), len(count) + bool(train)
    for r in rows:
        w = tokens[r.doc_id]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w) + 1, sum(x in count for x in w) + bool(train), n, fold(r.doc_id, 7) == 2)
        assert r.score < 0 or n == 0


@pytest.mark.parametrize("head", [brown.HEAD, 500])
def test_query_against_brute_force(spark, sf, monkeypatch, head):
    """With all words in the head, and with most of them joined in."""
    monkeypatch.setattr(brown.frequent, "__defaults__", (head, brown.HEAD_BYTES))
    texts = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    rows = queries.op9_brown_lm_scoring(spark, sf).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_the_head_changes_no_score(spark, monkeypatch):
    """Heads that hold all words as frequent as the clustered ones."""
    docs = documents(spark, "/root/testdata/sf0.01")
    monkeypatch.setattr(brown.frequent, "__defaults__", (30_000, brown.HEAD_BYTES))
    some = {r.doc_id: r.score for r in brown.score(docs).collect()}
    monkeypatch.setattr(brown.frequent, "__defaults__", (50_000, brown.HEAD_BYTES))
    for r in brown.score(docs).collect():
        assert r.score == pytest.approx(some[r.doc_id], rel=1e-9)


def test_classes_help_held_out_texts(spark):
    rows = [r for r in queries.op9_brown_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score - r.base_score for r in rows) > 0.2 * sum(r.n_tokens for r in rows)  # log10 a token over unigrams


def pairs(n):
    row, col = np.nonzero(n)
    return row, col, n[row, col]


def test_exchange_finds_classes():
    """Words that alternate between two groups end in two classes, and the likelihood never falls."""
    rng = np.random.default_rng(5)
    n = np.zeros((brown.TYPES, brown.TYPES), np.int64)
    for _ in range(20_000):
        a, b = rng.integers(0, 20, 2)
        n[a, 20 + b] += 1
        n[20 + b, a] += 1
    own = brown.exchange(pairs(n), classes=2, sweeps=20)
    assert len(set(own[:20])) == 1 and len(set(own[20:40])) == 1 and own[0] != own[20]


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(6)
    n = np.zeros((brown.TYPES, brown.TYPES), np.int64)
    n[:60, :60] = rng.poisson(rng.gamma(0.5, 2, (60, 60)))

    def likelihood(own):
        one = np.eye(brown.END_CLASS + 1)[own]
        t = one.T @ n @ one
        g = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return g(t) - g(t.sum(0)) - g(t.sum(1))

    scores = [likelihood(brown.exchange(pairs(n), sweeps=s)) for s in range(5)]
    assert scores == sorted(scores) and scores[4] > scores[0]


def test_probabilities_of_classes_sum_to_one(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    head = spark.sparkContext.broadcast(brown.frequent(brown.count_words(docs)))
    model = brown.fit(docs, head, docs.count())
    assert np.allclose((10**model.transition).sum(1), 1)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = brown.score(docs).collect()
    assert len(rows) == len(odd_rows())
    assert all((r.n_tokens, r.n_known) == (1, 1) for r in rows if r.doc_id in (0, 1, 2))
    assert all(not r.held_out for r in rows if r.doc_id is None)
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    check(brown.score(once).collect(), {i: t for i, t, *_ in odd_rows() if i is not None})
    assert brown.score(empty_documents(spark)).count() == 0


def test_nothing_to_learn(spark):
    held = [i for i in range(60) if fold(i, 7) == 2][:3]
    rows = brown.score(spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")).collect()
    assert all((r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) for r in rows)


def test_words_join_the_class_that_gains_most():
    """Against moving each word and counting the likelihood anew."""
    rng = np.random.default_rng(8)
    size, words = brown.END_CLASS + 1, 40
    own = brown.CLASSES + rng.integers(0, brown.SHAPES, words)
    kind = np.concatenate([np.arange(size), own])  # the first are words whose class is fixed
    n = rng.poisson(rng.gamma(0.3, 3, (len(kind), len(kind)))) * (rng.random((len(kind), len(kind))) < 0.3)
    g = lambda x: (x * np.log(np.maximum(x, 1))).sum()

    def table(classes):
        one = np.eye(size)[classes]
        return one.T @ n @ one

    def likelihood(t):
        return g(t) - g(t.sum(0)) - g(t.sum(1))

    one = np.eye(size)[kind]
    alone = n - np.diag(np.diag(n))
    got = brown.best_class(table(kind), own, (alone @ one)[size:], (alone.T @ one)[size:], np.diag(n)[size:].astype(float), 0.0)
    for w in range(words):
        each = {}
        for k in [*range(brown.CLASSES), own[w]]:
            moved = kind.copy()
            moved[size + w] = k
            each[k] = likelihood(table(moved))
        assert each[got[w]] == pytest.approx(max(each.values()), abs=1e-6)


def test_words_beyond_the_clustered_ones_have_learned_classes(spark):
    """Rare words that stand where frequent ones of a class do go to that class, whatever their shape; none is left out."""
    rng = np.random.default_rng(9)
    nouns, verbs = [f"noun{n}" for n in range(2100)], [f"verb{n}" for n in range(2100)]
    texts = [" ".join(f"{nouns[a]} {verbs[b]}" for a, b in rng.integers(0, 2100, (40, 2))) for _ in range(1600)]
    rare = {f"x{'y' * (n % 9)}{n}": n % 2 for n in range(60)}
    texts += [" ".join(f"{w if not side else nouns[a]} {verbs[b] if not side else w}" for a, b in rng.integers(0, 2100, (12, 2))) for w, side in rare.items()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    head = spark.sparkContext.broadcast(brown.frequent(brown.count_words(docs)))
    classed = {bytes(r.word).decode(): (r.c, r["class"]) for r in brown.cluster(brown.parts_of(docs.selectExpr("*", "false as held_out"), head), head).collect()}
    count = Counter(w for t in texts for w in t.split())
    assert {w: c for w, (c, _) in classed.items()} == count
    frequent = {w.decode() for w in head.value.words.split()[: brown.CLUSTERED]}
    sides = [{classed[w][1] for w in every if w in frequent} for every in (nouns, verbs)]
    right = sum(classed[w][1] in sides[side] - sides[1 - side] for w, side in rare.items())
    assert len(set(rare) - frequent) == 60 and right > 40


def brute_contexts(texts, clustered, own):
    """word -> counts of the classes that follow and precede, by walking the texts."""
    place = {w: n for n, w in enumerate(clustered)}
    kind = lambda w: own[place[w]] if w in place else brown.CLASSES + brown.shape(w)
    out = {}
    for t in texts:
        w = [None, *(x.encode() for x in words((t or "").translate(LOWER))), None]
        for a, b in zip(w, w[1:]):
            for me, other, side in ((a, b, 0), (b, a, 1)):
                if me is not None and me not in place:
                    at = side * brown.NEIGHBOURS + (brown.END_CLASS if other is None else brown.END_CLASS + 1 if other == me else kind(other))
                    out.setdefault(me, Counter())[at] += 1
    return out


@pytest.mark.parametrize("part, flush", [(1 << 20, 10**6), (40, 60), (1, 5)])
def test_contexts_across_parts_and_flushes(spark, sf, monkeypatch, part, flush):
    texts = [r.text for r in documents(spark, sf).limit(40).collect()] + ["a a a b", None, "", "x " * 90, "é É"]
    count = Counter(w.encode() for t in texts for w in words((t or "").translate(LOWER))).most_common(60)
    for name, value in (("PART", part), ("FLUSH", flush), ("HELD", flush), ("ROWS", 7), ("SOME", 3), ("CLUSTERED", 30)):
        monkeypatch.setattr(brown, name, value)
    own = np.arange(30) % brown.CLASSES
    head = brown.Head(b" ".join(w for w, _ in count), np.array([c for _, c in count]), np.array([brown.shape(w) for w, _ in count], np.uint8))
    kind = to_arrow_schema(spark.createDataFrame([], brown.PARTS).schema)
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "held_out": [False] * len(texts), "key": list(range(len(texts))), "text": texts})
    made = brown.contexts(brown.numbered(iter([rows]), head, kind), head, own)
    rows = sorted((r["word"], r["contexts"]) for b in made for r in b.to_pylist())
    cut = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[s : s + 5]], pa.binary()) for i in (0, 1)], names=["word", "contexts"]) for s in range(0, len(rows), 5)]
    got = {w: Counter({int(k): int(v) for k, v in enumerate(seen) if v}) for some, every in brown.by_word(iter(cut)) for w, seen in zip(some, every, strict=True)}
    clustered = [w for w, _ in count[:30]]
    assert got == brute_contexts(texts, clustered, own)


def test_texts_in_parts_score_alike(spark, sf, monkeypatch):
    docs = documents(spark, sf)
    whole = {r.doc_id: r.score for r in brown.score(docs).collect()}
    long = docs.unionByName(docs.limit(1).selectExpr("-5L as doc_id", "repeat('one two three four five six ', 60000) as text", "lang", "source", "n_chars"))
    rows = {r.doc_id: r for r in brown.score(long).collect()}
    assert rows[-5].n_tokens == 360_001 and set(rows) == {*whole, -5}
    check(list(rows.values()), {r.doc_id: r.text for r in long.collect()})


def test_a_text_of_many_distinct_words_takes_little_memory():
    """Ten million distinct words in one text: the task holds a part of them at a time."""
    import tracemalloc

    docs = type("Docs", (), {})()
    docs.select = lambda *_: docs
    docs.mapInArrow = lambda f, _: docs.__dict__.setdefault("run", f) and docs
    docs.groupBy = lambda *_: docs
    docs.agg = lambda *_: docs
    brown.count_words(docs)
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, range(10_000_000)))])], names=["text"])
    tracemalloc.start()
    n = sum(b.num_rows for b in docs.run([batch]))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert n == 10_000_000 and most < 79 * 4 + 90  # the text, as Python has it three times over, and what the task holds
