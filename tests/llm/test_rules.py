from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lightgraph.llm import queries, rules

from .helpers import documents, empty_documents, odd_documents, odd_rows, words


def brute(text):
    w = words(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    rows = queries.op2_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, *rest = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 10 or 100 * rest[-1] > 20 * n)
        assert not (r.base_failed and r.kept)


def test_long_texts_are_ranked_alike(monkeypatch, spark, sf):
    texts = [r.text for r in documents(spark, sf).limit(60).collect()] + [t for _, t, *_ in odd_rows()] + ["a b c d e " * 9, "a a a a a a a", "a b c d"]
    usual = [rules.counts(t) for t in texts]
    monkeypatch.setattr(rules, "MANY", 3)
    assert [rules.counts(t) for t in texts] == usual


def test_buckets():
    values = [*range(3000), 10**6, 2**40 + 7]
    at = [rules.bucket(v) for v in values]
    assert at == sorted(at)


def test_bucket_values(spark):
    rows = spark.range(5000).withColumn("b", F.udf(rules.bucket, "int")("id")).select("id", rules.bucket_value(F.col("b")).alias("v")).collect()
    assert all(r.v <= r.id < r.v * 17 / 16 + 1 for r in rows)


def test_sketches_merge(spark, sf):
    measured = rules.measure(documents(spark, sf))
    whole = {tuple(r) for r in rules.sketches(measured).collect()}
    halves = rules.sketches(measured.where("doc_id % 2 = 0")).unionByName(rules.sketches(measured.where("doc_id % 2 = 1")))
    merged = halves.groupBy("lang", "source", "measure", "bucket").agg(F.sum("docs").alias("docs"))
    assert {tuple(r) for r in merged.collect()} == whole


def test_thresholds_adapt(spark):
    """A source where symbols are usual keeps its documents; the same text is an outlier elsewhere."""
    noisy, clean = "w# " * 40, "word " * 40
    unique = lambda t, i: " ".join(f"{w}{i}{n}" for n, w in enumerate(t.split()))
    rows = [(i, unique(noisy, i), "en", "noisy") for i in range(200)] + [(1000 + i, unique(clean, i), "en", "clean") for i in range(200)] + [(5000, unique(noisy, 5000), "en", "clean")]
    got = {r.doc_id: r.kept for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(200)) and all(got[1000 + i] for i in range(200)) and not got[5000]


def test_quartiles_are_near_the_exact_ones(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 900, 4000)
    sketch = spark.createDataFrame([(rules.bucket(int(v)), 1) for v in values], "bucket int, docs long").selectExpr("'en' lang", "'s' source", "'m' measure", "bucket", "docs")
    r = rules.quartiles(sketch, ["lang", "source"]).select(rules.bucket_value(F.col("b1")).alias("a"), rules.bucket_value(F.col("b3")).alias("b")).collect()[0]
    for got, q in ((r.a, 0.25), (r.b, 0.75)):
        exact = np.quantile(values, q)
        assert exact * 15 / 16 - 1 <= got <= exact + 1


def test_odd_rows(spark):
    rows = rules.judge(odd_documents(spark)).collect()
    assert len(rows) == len(odd_rows())
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in rows if r.doc_id in (0, 1, 2))
    assert rules.judge(empty_documents(spark)).count() == 0
