"""SimHash near-dedup: tiled exact comparison of fingerprints with numpy.

Distinct fingerprints are cut into lanes. Two that differ in three bits or fewer agree in one of
four lanes and in two of five, so comparing all pairs within the tiles (agreeing lanes, leading
bits of them) finds every link. The number of leading bits follows the number of fingerprints, so
a tile keeps its size as the table grows: one tile up to TILE fingerprints, tiles by one of four
lanes up to 2^28, by two of five lanes (ten tables of 25 bits) beyond. In a tile the fingerprints
are sorted by population count and compared in squares with exclusive-or and bit counts; a square
whose population counts differ beyond the radius is skipped. A tile far above its size is dealt
out as pairs of chunks. Tiles return a spanning forest of their links, not the pairs: no link is
lost between components.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other; copies
share a fingerprint and are never compared; repeated rows get the same component; a null doc_id
is no component's smallest unless there is no other; an empty table gives an empty result; only
doc_id and text are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import map_batches
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints in a tile, about; a tile beyond HOT is dealt out in chunks of TILE. SQUARE: the side of one comparison.
TILE, HOT, SQUARE = 4096, 16384, 512


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id and fp (a signed long) of every document, and the columns named."""
    kinds = dict(docs.dtypes)

    def make():
        return lambda batch: [batch.column("doc_id"), *(batch.column(c) for c in keep), [fingerprint(t) for t in batch.column("text").to_pylist()]]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    return map_batches(rows, make, "doc_id long, " + "".join(f"{c} {kinds[c]}, " for c in keep) + "fp long")


def forest(fps: np.ndarray, own: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints. own: the chunk of each, to skip pairs within one
    chunk that another task compares."""
    bits = np.bitwise_count(fps)
    order = np.argsort(bits, kind="stable")
    fps, bits = fps[order], bits[order].astype(np.int64)
    own = None if own is None else own[order]
    n = len(fps)
    root = np.arange(n)

    def unite(i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = root[i], root[j]
            if (same := a == b).all():
                return
            low = np.minimum(a, b)[~same]
            np.minimum.at(root, a[~same], low)
            np.minimum.at(root, b[~same], low)
            while not np.array_equal(root, up := root[root]):
                root[:] = up

    for s in range(0, n, SQUARE):
        e = min(s + SQUARE, n)
        for t in range(s, n, SQUARE):
            if bits[t] - bits[e - 1] > radius:
                break
            near = np.bitwise_count(fps[s:e, None] ^ fps[None, t : t + SQUARE]) <= radius
            if s == t:
                near = np.triu(near, 1)
            if own is not None:
                near &= own[s:e, None] != own[None, t : t + SQUARE]
            i, j = np.nonzero(near)
            if len(i):
                unite(i + s, j + t)
    moved = np.flatnonzero(root != np.arange(n))
    return fps[moved], fps[root[moved]]


def tile_values(n: int) -> list[Column]:
    """What fingerprints of one tile have in common, for each of the tables of tiles that n fingerprints are dealt to."""
    lead = max(0, int(np.ceil(np.log2(max(1, n) / TILE))))
    part = lambda first, bits: F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))
    if lead == 0:
        return [F.lit(0).cast("long")]
    if lead <= 16:
        return [F.shiftright(part(16 * k, 16), 16 - lead) for k in range(4)]
    edges = np.linspace(0, 64, 6).astype(int).tolist()
    lane = [part(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [F.shiftleft(lane[i], 13).bitwiseOR(lane[j]) for i, j in combinations(range(5), 2)]


def links(distinct: DataFrame, n: int) -> DataFrame:
    """Edges (u, v) that connect all fingerprints fp which differ in RADIUS bits or fewer."""
    lanes = [F.struct(F.lit(k).alias("lane"), value.alias("lead")) for k, value in enumerate(tile_values(n))]
    tiles = distinct.select("fp", F.explode(F.array(*lanes)).alias("tile")).select("fp", "tile.lane", "tile.lead")
    hot = tiles.groupBy("lane", "lead").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT)
    if hot.isEmpty():
        tiles = tiles.withColumns({"a": F.lit(0), "b": F.lit(0), "own": F.lit(0)})
    else:  # every pair of chunks meets in one task; a chunk's own pairs in the task (own, own)
        parts = F.coalesce(F.ceil(F.col("rows") / TILE).cast("int"), F.lit(1))
        dealt = tiles.join(hot, ["lane", "lead"], "left").withColumn("parts", parts)
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        tiles = dealt.select("fp", "lane", "lead", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own")

    def compare(table: pa.Table) -> pa.Table:
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        u, v = forest(table.column("fp").to_numpy().view(np.uint64), None if a == b else table.column("own").to_numpy())
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return tiles.groupBy("lane", "lead", "a", "b").applyInArrow(compare, "u long, v long")


def classes(fps: DataFrame) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of a written table (doc_id, fp)."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    grouped = materialize(components(links(distinct, distinct.count()), "simhash-edges"), "simhash-components")
    named = grouped.withColumnRenamed("node", "fp").join(distinct, "fp")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.join(smallest, "root").select("fp", "component_id")
    return materialize(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "simhash-classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hex, component_id for every document."""
    fps = materialize(fingerprints(docs), "simhash-fps")
    return fps.join(classes(fps), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with all its columns. Of repeated rows one stays."""
    columns = docs.columns
    row = docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*(docs[c] for c in columns)).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def make():
        return lambda batch: [batch.column("key"), batch.column("row"), batch.column("doc_id"), [fingerprint(t) for t in batch.column("text").to_pylist()]]

    # The keys and fingerprints are written with their rows, once, so no later read can number the rows anew.
    kind = T.StructType([*(row.schema[c] for c in ("key", "row", "doc_id")), T.StructField("fp", T.LongType())])
    kept = materialize(map_batches(row, make, kind), "simhash-rows")
    fps = kept.select("key", "doc_id", "fp")
    whole = fps.join(classes(fps.select("doc_id", "fp")), "fp").select("key", "fp", "component_id", F.struct(F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(10).cast("decimal(20,0)") ** 19), "key").alias("rank"))
    first = whole.groupBy(F.coalesce("component_id", "fp").alias("component"), F.col("component_id").isNull().alias("anonymous")).agg(F.min("rank").alias("rank"))
    return kept.join(first.select(F.col("rank.key").alias("key")), "key", "left_semi").select("row.*")
