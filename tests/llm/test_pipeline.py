import inspect

import corpus_pipeline
from lightgraph.llm import langid, quality

from .helpers import documents, empty_documents, odd_documents
from .test_langid import plain_language
from .test_packing import check
from .test_pii import brute
from .test_quality import plain_scores
from .test_simhash import brute_components


def plain_mask(text):
    """Every plain span replaced by its kind, overlapping ones as one; the tables hold no disguised ones (test_pii)."""
    out, done = [], 0
    for start, kind, end in sorted(brute(text or ""), key=lambda s: (s[0], -s[2])):
        if start >= done:
            out += [text[done:start], "<" + ("EMAIL", "IP", "CARD", "PHONE")[kind] + ">"]
        done = max(done, end)
    return "".join([*out, text[done:]]) if out else text


def test_rows_against_brute_force(spark, sf):
    """The models are those that the stages fit; what they decide, and every other stage, is done again in plain Python."""
    docs = documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = langid.fit(docs)
    told = {i: plain_language(model, t) for i, t in rows.items()}
    rows = {i: t for i, t in rows.items() if told[i][0] != "und" and told[i][1] >= 0.3}
    after = docs.where(docs.doc_id.isin(list(rows)))
    scores = plain_scores(quality.fit(after, labels), rows.values())
    rows = {i: t for (i, t), s in zip(rows.items(), scores, strict=True) if s >= 0.5}
    parts = brute_components(list(rows.items()))
    rows = {i: t for (i, t), (_, c) in zip(rows.items(), parts, strict=True) if c == i}
    check(corpus_pipeline.run(spark, sf).collect(), {i: plain_mask(t) for i, t in rows.items()})


def test_odd_rows(spark, sf, tmp_path):
    """Nulls in any column, repeated rows, empty and very long texts among ordinary documents."""
    docs = documents(spark, sf)
    odd = odd_documents(spark).selectExpr("doc_id + 1000000 as doc_id", "text", "lang", "source", "cast(n_chars as long) as n_chars")
    odd.unionByName(docs.withColumn("n_chars", docs.n_chars.cast("long"))).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in by_sequence.values():
        assert [o for o, _ in sorted(some)] == [sum(n for o, n in some if o < p) for p, _ in sorted(some)]
    assert {r.doc_id for r in rows} <= {None, *(r.doc_id for r in docs.collect()), *range(1_000_000, 1_000_100)} and len(rows) > 50


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "SimHash near-dedup", "PII", "best-fit packing"]
    docs = empty_documents(spark)
    for number, (_, f) in enumerate(corpus_pipeline.STAGES):
        assert list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"]
        out = f(spark, docs, sf)
        assert out.count() == 0
        if number < 4:
            assert out.columns == docs.columns
