import re

import pytest
from pyspark.sql import functions as F

from lightgraph.functions import lookups as lk
from lightgraph.operators import text, triples

DOCS = "document_id string, text string"


def test_word_windows(spark):
    docs = spark.createDataFrame([("d", "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), ("e", " "), ("f", "one")], DOCS)
    got = text.chunk_words(docs, 5, 2, 1).orderBy("document_id", "chunk_id").collect()
    assert [r.text for r in got] == ["w0 w1 w2 w3 w4", "w3 w4 w5 w6 w7", "w6 w7 w8 w9 w10", "one"]
    assert [(r.start_char, r.end_char) for r in got[:3]] == [(0, 14), (15, 29), (30, 45)]
    assert text.chunk_words(docs, 5, 2, 2).count() == 3
    with pytest.raises(ValueError):
        text.chunk_words(docs, 5, 5)


def test_sentences(spark):
    long = "One two. Three four five! Six? " + "word " * 12 + "end. Last"
    assert text.packed_sentences(long, 5) == ["One two. Three four five!", "Six?", ("word " * 12 + "end.").strip(), "Last"]
    assert text.packed_sentences("", 5) == [] and text.packed_sentences("No end", 5) == ["No end"]
    got = text.chunk_sentences(spark.createDataFrame([("d", long), ("e", None)], DOCS), 5).orderBy("chunk_id").collect()
    assert [r.start_char for r in got] == [0, 26, 31, 31 + len(got[2].text) + 1]


def test_tokens(spark):
    docs = spark.createDataFrame([("d", "abcdefghijk"), ("e", "")], DOCS)
    got = text.chunk_tokens(docs, lambda: (list, "".join), 5, 2, 1).orderBy("chunk_id").collect()
    assert [r.text for r in got] == ["abcde", "defgh", "ghijk"]


QUESTIONS = {
    "What is machine learning?": "Definition", "Define artificial intelligence": "Definition", "Explain what neural networks are": "Definition", "Why does this happen?": "Causation",
    "What causes climate change?": "Causation", "What leads to success?": "Causation", "What do I need to learn Python?": "Requirements", "Prerequisites for data science": "Requirements",
    "How to build a website": "Requirements", "What's similar to Python?": "Similarity", "Alternatives to TensorFlow": "Similarity", "Tell me about Python": "Association", "Python programming": "Association",
}


def test_intents(spark):
    df = spark.createDataFrame([(q,) for q in QUESTIONS], "q string").withColumns({"i": lk.intent(F.col("q")), "c": lk.intent_confidence(F.col("q"))})
    for r in df.collect():
        assert r.i == QUESTIONS[r.q] and 0.3 <= r.c.confidence <= 1
    r = df.where("q = 'Python programming'").collect()[0]
    assert (r.c.intent, r.c.confidence) == ("Association", 0.3)
    tie = spark.createDataFrame([("why similar",)], "q string").select(lk.intent_confidence(F.col("q")).alias("c")).collect()[0].c
    assert tie.intent == "Similarity"  # the later of two with one phrase each


def test_relations(spark):
    known = {"is_a": 0, "requires": 1, "related_to": 2, "causes": 4, "contains": 6, "part_of": 8, "similar_to": 10, "opposite_of": 12, "enables": 14, "conflicts_with": 15, "IS_A": 0, "IsA": 0, "Part Of": 8, "part-of": 8, "nothing": 2}
    df = spark.createDataFrame(list(known.items()), "r string, b int")
    assert df.where(lk.relation_bin(F.col("r")) != F.col("b")).count() == 0
    assert df.where("r = 'nothing'").select(lk.relation_bin(F.col("r"), 7).alias("x")).collect()[0].x == 7
    assert len(lk.RELATION_BINS) == 53 and len(lk.BUILDER_BINS) == 21


def test_vocabulary_and_mapping(spark):
    t = spark.createDataFrame([("a", "is_a", "b"), ("b", "Causes", "c")], "head string, relation string, tail string")
    vocab = triples.entity_vocab(t)
    assert {r.entity: r.entity_id for r in vocab.collect()} == {"a": 0, "b": 1, "c": 2}
    assert sorted(tuple(r) for r in triples.map_triples(t, vocab).collect()) == [(0, 0, 1), (1, 4, 2)]
    assert triples.map_triples(t, vocab.where("entity <> 'c'")).count() == 1
    assert [(r.relation, r.n) for r in triples.relation_statistics(t).collect()] == [("causes", 1), ("is_a", 1)]


def test_split(spark):
    t = spark.range(100).select(F.col("id").cast("string").alias("head"), F.lit("r").alias("relation"), F.lit("t").alias("tail"))
    train, test = triples.split(t, 0.2)
    assert (train.count(), test.count()) == (80, 20) and train.intersect(test).count() == 0
    assert triples.split(t, 0.2)[1].exceptAll(test).count() == 0 and triples.split(t, 0.2, 7)[1].exceptAll(test).count() > 0
    with pytest.raises(ValueError):
        triples.split(t, 1.5)


def test_negatives(spark):
    m = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (4, 0, 5)], "head_id long, angle_bin int, tail_id long")
    got = triples.negatives(m, 10, 4).collect()
    assert len(got) == 12
    valid = {(0, 1, 2), (0, 1, 3), (4, 0, 5)}
    assert all((r.head_id, r.angle_bin, r.negative) not in valid for r in got)
    assert triples.negatives(m.limit(1), 3, 4).count() == 4  # too few entities: valid ones fill up


def test_negatives_of_crowded_heads(spark):
    """A head with most entities as tails takes all its draws, others the first ones: the same as drawing in full for all."""
    m = spark.createDataFrame([(0, 1, t) for t in range(50)] + [(h, 2, h % 7) for h in range(1, 30)], "head_id long, angle_bin int, tail_id long").distinct()
    got = sorted(tuple(r) for r in triples.negatives(m, 60, 4).collect())
    full = triples._best_draws(m, m, 60, 4, 42, 40).select("head_id", "angle_bin", "tail_id", (F.col("rank") - 1).alias("n"), "negative")
    assert got == sorted(tuple(r) for r in full.collect()) and len(got) == 79 * 4
    assert triples.negatives(m.limit(0), 60, 4).count() == 0
    assert sorted(tuple(r) for r in triples.negatives(m, 60, 4, of=m.where("head_id = 3")).collect()) == [r for r in got if r[0] == 3]


def test_contrastive(spark):
    c = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0), ("c", 1)], "document_id string, chunk_id int")
    for r in triples.contrastive(c).collect():
        assert r.negative_document != r.document_id
        assert (r.positive_chunk != r.chunk_id) == (r.document_id != "b")
    one = triples.contrastive(c.where("document_id = 'b'")).collect()[0]
    assert (one.negative_document, one.negative_chunk, one.positive_chunk) == ("b", 0, 0)


def test_no_other_code_names_llm():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "lightgraph"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_complement_negatives(spark, block):
    """k distinct entities that aren't valid for every triple, also where nearly all or all entities are; each can come up."""
    n, k = 23, 4
    rows = [(0, 0, t) for t in range(n) if t not in (2, 11, 12, 22, 5, 6)] + [(1, 0, t) for t in range(n) if t not in (0, 20)] + [(2, 3, t) for t in range(n)] + [(3, 1, 9), (3, 1, 9), (3, 2, 0), (4, 0, 99)]
    mapped = spark.createDataFrame(rows, "head_id long, angle_bin int, tail_id long")
    got: dict = {}
    for r in triples.complement_negatives(mapped, n, k, block=block).collect():
        got.setdefault((r.head_id, r.angle_bin, r.tail_id), []).append((r.n, r.negative))
    for h, b, t in set(rows):
        free = set(range(n)) - {y for a, c, y in rows if (a, c) == (h, b)}
        mine = sorted(got.get((h, b, t), []))
        assert [i for i, _ in mine] == list(range(min(k, len(free))))
        assert len({e for _, e in mine}) == len(mine) and {e for _, e in mine} <= free and (len(free) > k or {e for _, e in mine} == free)
    assert {e for key, es in got.items() if key[0] == 0 for _, e in es} == {2, 5, 6, 11, 12, 22}
    assert triples.complement_negatives(mapped.limit(0), n, k).count() == 0
