import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from lightgraph.llm import queries, warc

SCHEMA = "page_id long, url string, html string, digest string, offset long, archive string"


def brute(rows):
    body = [(i, (h or "").encode()) for i, _, h, *_ in rows]
    first: dict = {}
    for i, b in body:
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, b in body:
        f = first.get(b) if len(b) >= 100 else None
        again = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(queries.op7_warc_index_first(spark, sf)) == brute(rows)


def odd(spark):
    big = "é" * 200_000
    rows = [(1, "http://a", "x" * 99), (2, "http://b", "x" * 99), (9, None, "y" * 100), (4, "u\r\nWARC-Type: metadata", "y" * 100), (5, "", None), (6, "e", ""), (7, "f", big), (8, "g", big), (None, "h", "y" * 100), (None, "i", "z" * 500), (11, "j", "z" * 500), (4, "k", "y" * 100), (12, "l", "a\r\n\r\nb" * 40), (13, "m", "WARC/1.1\r\n" * 20)]
    return [(*r, "clash", 5, "clash") for r in rows]


@pytest.mark.parametrize("common", [0, 2, 10_000])
def test_odd_rows(spark, monkeypatch, common):
    """With payloads that count as common ones, all, some and none of them."""
    monkeypatch.setattr(warc, "COMMON", common)
    rows = odd(spark)
    assert got(warc.round_trip(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_payloads_come_back(spark):
    rows = [r for r in odd(spark) if r[0] is not None]
    pages = spark.createDataFrame(rows, SCHEMA)
    index = warc.write(pages)
    back = warc.read(index)
    texts = {(r[0], r[1]): (r[2] or "") for r in rows}
    for r in back.collect():
        key = next(k for k in texts if k[0] == r.page_id and (k[1] or "").replace("\r", "%0D").replace("\n", "%0A") == (r.url or ""))
        assert r.payload is None if r.record_type == "revisit" else r.payload.decode() == texts[key]
    some = warc.read(index.where("page_id in (7, 12)"))  # a selection reads its ranges only
    assert sorted(r.page_id for r in some.collect()) == [7, 12]


def test_archives_are_plain_gzip_members(spark):
    index = warc.write(spark.createDataFrame(odd(spark), SCHEMA))
    paths = {r.archive for r in index.select("archive").collect()}
    n = 0
    for p in paths:
        with gzip.open(p.removeprefix("file://"), "rb") as f:
            data = f.read()
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        n += data.count(b"WARC-Record-ID: <urn:page:")
    assert n == index.count()


def test_readers_follow_the_bytes(spark, monkeypatch):
    index = warc.write(spark.createDataFrame(odd(spark), SCHEMA))
    monkeypatch.setattr(warc, "STRETCH", 200)
    tasks = warc.read(index).select(F.spark_partition_id().alias("p"), "page_id")
    size = sum(r.length for r in index.collect())
    assert tasks.rdd.getNumPartitions() == -(-size // 200) and tasks.count() == index.count()


def test_ranges():
    places = [(0, 10), (10, 5), (100, 10), (100_000, 10), (100_020, 50)]
    made = warc.ranges(places, gap=90, most=1000)
    assert [(s, e, len(p)) for s, e, p in made] == [(0, 110, 3), (100_000, 100_070, 2)]
    assert [p for _, _, some in warc.ranges(places, 0, 1) for p in some] == places
    assert warc.ranges([]) == []
