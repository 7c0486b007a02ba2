import hashlib
from collections import defaultdict

import pytest

from lightgraph.llm import exact, queries

from .helpers import LOWER, documents, empty_documents, odd_documents, odd_rows


def brute(rows, largest=True):
    """(doc_id, keep_id, group_size, sha256) of each row (doc_id, text)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    best = max if largest else min
    found = []
    for i, t in rows:
        plain = (t or "").translate(LOWER)
        ids = [x for x in groups[plain] if x is not None]
        found.append((i, best(ids) if ids else None, len(groups[plain]), hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(found, key=str)


def found(df):
    rows = df.collect()
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str)


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    got = queries.op13_exact_dedup_tree(spark, sf)
    assert found(got) == brute(rows)
    assert got.schema.simpleString() == "struct<doc_id:bigint,keep_id:bigint,group_size:bigint,kept:boolean,text_sha256:string>"


@pytest.mark.parametrize("largest", [True, False])
def test_odd_rows(spark, largest):
    rows = odd_documents(spark)
    assert found(exact.classes(rows, largest)) == brute([(i, t) for i, t, *_ in odd_rows()], largest)
    assert exact.classes(empty_documents(spark)).count() == 0


def test_only_unknown_ids(spark):
    rows = [(None, "A"), (None, "a"), (None, "b"), (4, "B"), (-3, "b")]
    got = exact.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == sorted(
        [(None, None, 2, True), (None, None, 2, False), (None, 4, 3, False), (4, 4, 3, True), (-3, 4, 3, False)], key=str
    )


@pytest.mark.parametrize("lead_bits", [64, 3, 0])
def test_many_runs_and_colliding_leads(spark, lead_bits):
    """Runs of five rows take three rounds; leads of three bits or none collide all over, and the digests keep the texts apart."""
    rows = [(i, f"text {'ab'[i % 2] * (i % 7)}" if i % 3 else "Hot TEXT") for i in range(2000)] + [(9000 + i, f"Only {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(exact.classes(df, run_rows=5, lead_bits=lead_bits)) == brute(rows)


def test_a_hot_text_is_one_entry_of_a_run(spark):
    rows = [(i, "same" if i % 3 else f"text {i}") for i in range(900)]
    runs = exact.digested(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 50, 64, True)
    entries = runs.where("n > 0 and size = 4").groupBy("run").count().collect()
    assert len(entries) >= 18 and all(r["count"] == 1 for r in entries)
    order = [(r.run, r.lead) for r in runs.collect()]
    assert all(a[0] != b[0] or a[1] % 2**64 <= b[1] % 2**64 for a, b in zip(order, order[1:]))
