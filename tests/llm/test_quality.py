import math

import numpy as np
import zstandard

from lightgraph.llm import quality, queries

from .helpers import documents, empty_documents, fold, odd_documents


def auc(score, label):
    order = score.rank()
    good, bad = (label == 1).sum(), (label == 0).sum()
    return (order[label == 1].sum() - good * (good + 1) / 2) / (good * bad)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op1_quality_classifier(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    docs = documents(spark, sf).count()
    assert len(rows) == docs and rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    assert all(h == (fold(i, 3) == 1) for i, h in zip(rows.doc_id, rows.held_out))
    apart = rows.merge(labels, on="doc_id")
    apart = apart[apart.held_out]
    assert auc(apart.score, apart.quality) > 0.98 and (apart.predicted == apart.quality).mean() > 0.97


def test_few_labels_suffice(spark):
    sf = "/root/testdata/sf0.01"  # 286 labelled rows to learn from
    rows = queries.op1_quality_classifier(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    apart = rows[rows.held_out]
    assert (apart.predicted == apart.quality).mean() > 0.95


def test_labels_of_the_held_out_fold_change_nothing(spark, sf):
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, flipped)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 1), (6, 0), (8, 0), (9, 1), (None, 1), (10, None), (12, 7), (77, 0), (15, 1), (16, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (0, 1)}
    assert len(empty) == 1  # null and empty alike
    kept = quality.keep(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert quality.score(empty_documents(spark), model).count() == 0


def test_nothing_to_learn(spark):
    docs, none = odd_documents(spark), spark.createDataFrame([], "doc_id long, quality int")
    for d, la in ((docs, none), (empty_documents(spark), none), (docs, spark.createDataFrame([(5, 1)], "doc_id long, quality int"))):
        assert {r.score for r in quality.score(docs, quality.fit(d, la)).collect()} == {0.5}


def test_logistic_recovers_a_curve():
    rng = np.random.default_rng(1)
    d = rng.standard_normal((4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * d[:, 0] - d[:, 1] + 0.5)))).astype(float)
    (a, b), c = quality.logistic(d, y, np.ones(4000))
    assert abs(a - 2) < 0.25 and abs(b + 1) < 0.25 and abs(c - 0.5) < 0.2


def plain_scores(model, texts):
    """From the library's compressed sizes and the fitted curve."""
    pair = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    empty, out = [len(c.compress(b"")) for c in pair], []
    for text in texts:
        data = (text or "").encode()
        good, bad = (1 + sum(len(c.compress(data[s : s + 2048])) - e for s in range(0, len(data), 2048)) for c, e in zip(pair, empty))
        x = model.bias + (model.weights[0] * (bad - good) / (bad + good) + model.weights[1] * math.log(2 * len(data) / (bad + good)) if data else 0)
        out.append(1 / (1 + math.exp(-max(-40, min(40, x)))))
    return out


def test_query_against_plain_compression(spark, sf):
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = {r.doc_id: r for r in queries.op1_quality_classifier(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(rows) == set(texts)
    for i, score in zip(texts, plain_scores(model, texts.values())):
        assert abs(rows[i].score - score) < 1e-9 and rows[i].predicted == (score >= 0.5) and rows[i].held_out == (fold(i, 3) == 1)


def test_one_label_on_many_rows_is_one_row(spark, sf):
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    usual = quality.fit(docs, labels)
    one = docs.join(labels, "doc_id").limit(1).select(docs.columns)
    assert quality.fit(docs.unionByName(one.crossJoin(spark.range(500)).drop("id")), labels) == usual
