import numpy as np
from pyspark.sql import functions as F

from lightgraph.llm import langid, queries

from .helpers import documents, empty_documents, fold, odd_documents


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    true = {r.doc_id: r.lang for r in documents(spark, sf).collect()}
    rows = queries.op4_language_id(spark, sf).collect()
    assert len(rows) == len(true) and all(0 <= r.score <= 1 and r.held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    apart = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in apart) / len(apart) > 0.99


def test_families(spark, sf):
    model = langid.fit(documents(spark, sf))
    assert model.families == ["germanic", "romance"] and model.members == [["de", "en"], ["es", "fr"]]
    assert [p[1:] for p in model.pairs] == [("de", "en"), ("es", "fr")]


def test_unknown_languages_are_families(spark):
    rows = [(i, "abc abd abe " * 5 if i % 2 else "xyz xyw xyv " * 5, "q1" if i % 2 else "q2") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.families == ["q1", "q2"] and not model.pairs
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_one_language(spark):
    docs = spark.createDataFrame([(i, "only one language", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, langid.fit(docs)).collect()} == {("en", 1.0)}


def test_odd_rows(spark, sf):
    docs = odd_documents(spark)
    model = langid.fit(documents(spark, sf))
    rows = langid.identify(docs, model).collect()
    assert len(rows) == docs.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (0, 1, 2, 6, 14, 15))
    assert all(r.lang_pred != "und" for r in rows if r.doc_id in (3, 7, 8, 9, 16))
    assert langid.keep(docs, model).columns == docs.columns
    assert langid.identify(empty_documents(spark), model).count() == 0


def test_nothing_to_learn(spark):
    docs = odd_documents(spark)
    model = langid.fit(empty_documents(spark))
    assert {r.lang_pred for r in langid.identify(docs, model).collect()} == {"und"}


def test_long_texts_count_whole():
    a, b = "abc " * 400_000, "xyz " * 400_000
    mixed, start = langid.features([a + b, a])
    assert abs(mixed - start).max() > 0.05


def test_weakly_told_texts_go(spark):
    """Two families alike, and two languages alike in one: a score of a quarter."""
    flat = lambda n: np.zeros((n, langid.DIM + 1), np.float32)
    model = langid.Model(["f", "g"], [["a", "b"], ["c"]], flat(2), [(1.0, 0.0)] * 2, [(0, "a", "b")], flat(1), [(1.0, 0.0)])
    docs = spark.createDataFrame([(0, "some text")], "doc_id long, text string")
    assert model.predict(["some text"])[1] == [0.25]
    assert langid.keep(docs, model).count() == 0 and langid.keep(docs, model, 0.2).count() == 1


def test_held_out_languages_and_other_columns_change_nothing(spark, sf):
    """Predictions come from the text alone, and what is learned from the other folds alone."""
    docs = documents(spark, sf)
    fold_ = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    other = docs.withColumn("lang", F.when(fold_ == 2, F.lit("en")).otherwise(F.col("lang"))).withColumn("text", F.when((fold_ == 2) & (F.col("doc_id") % 2 == 0), F.lit("only this")).otherwise(F.col("text"))).withColumn("source", F.lit("x"))
    a, b = langid.fit(docs), langid.fit(other)
    assert a.members == b.members and np.array_equal(a.family_machines, b.family_machines) and np.array_equal(a.pair_machines, b.pair_machines)
    texts = [r.text for r in docs.limit(60).collect()]
    rows = spark.createDataFrame([(9000 + i, t, "zz" if i % 2 else None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in langid.identify(rows, a).collect()}
    langs, scores = a.predict(texts)
    assert got == {9000 + i: (la, round(s, 6)) for i, (la, s) in enumerate(zip(langs, scores))}


def plain_language(model, text):
    """Language and score by hand: the family of the likeliest machine, in it the language with most votes, ties by margins."""
    if not langid.has_letter(text) or not model.families:
        return "und", 0.0
    x = langid.features([text])[0].astype(float)
    margin = lambda m: float(x @ m[:-1].astype(float) + m[-1])
    chance = lambda m, c: 1 / (1 + np.exp(-(c[0] * margin(m) + c[1])))
    family = [chance(m, c) for m, c in zip(model.family_machines, model.family_curves)] or [1.0]
    f = int(np.argmax(family))
    votes, sums, least = ({k: v for k in model.members[f]} for v in (0, 0.0, 1.0))
    for (of, a, b), m, c in zip(model.pairs, model.pair_machines, model.pair_curves):
        if of == f:
            votes[a if margin(m) >= 0 else b] += 1
            for k, side in ((a, 1), (b, -1)):
                sums[k] += side * margin(m)
                p = chance(m, c)
                least[k] = min(least[k], p if side > 0 else 1 - p)
    best = max(votes, key=lambda k: (votes[k], sums[k]))
    return best, family[f] / sum(family) * least[best]


def test_query_against_plain_loops(spark, sf):
    docs = documents(spark, sf)
    model = langid.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op4_language_id(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        lang, score = plain_language(model, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4


def test_many_languages_are_all_learned(spark):
    """More languages than any cap would let through."""
    rows = [(i, " ".join(chr(0x4E00 + 40 * (i % 230) + j % 40) * 3 for j in range(30)), f"l{i % 230}") for i in range(230 * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.families) == 230
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("lang = lang_pred").count()
    assert got > 0.95 * len(rows)
