"""Approximate nearest neighbours by multi-index hashing.

Rotations learned by iterative quantization turn vectors into binary codes. Codes are split into
substrings of about log2(rows) bits, and one table holds a row (substring, value, code) for each:
the index, written once. For a Hamming radius r and m substrings, a code within r agrees with the
query's to r // m bits in one substring at least (to one bit less in all but the first r % m + 1),
so an equality join of the index with every value that near, and a check of whole codes, retrieves
exactly the codes within r. What is retrieved is ranked by distances of the original vectors in
double precision.

The radius is each query's own: an upper bound on its k-th distance, from a bounded sample, gives
the Hamming distance under which a learned share of pairs so near stays. Where the values that
near are more than PROBES, or would meet more than PROBED_SHARE of all codes, no index by
substrings can prune; for such a query all codes are checked, in blocks, which retrieves the same
set. probing() tells which queries are which. A query that finds too few is asked again with all
bits as its radius, so every query has its k.

Equal vectors are one entry of the index with its k + 1 smallest ids, which is all that any query
can return of them, so large groups of copies cost one comparison.

Defined cases: vectors that are null or zero, that hold a null or non-finite component, or whose id
is null take no part; vectors are near only to those of their own length, and each length has an
index of its own; repeated rows of one id and vector count once; an id with several vectors is one
candidate, by its nearest, and one query, by the nearest to any of them; fewer than k candidates
are all returned; an empty table gives an empty result; only vec_id and
embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_batches

BITS = 256
#: Bits of a substring, at least and at most.
NARROW, WIDE = 8, 24
#: Values that a query looks up at most, and the share of codes that they may meet, for it to probe.
PROBES, PROBED_SHARE = 100_000, 0.05
#: Vectors that fit the rotations and the radius, and of them those that act as queries for it.
SAMPLE, SAMPLE_QUERIES = 8192, 512
#: Share of near pairs within the radius, and the pairs that one radius is learned from and that lie between two.
SHARE, WINDOW, STEP = 0.98, 400, 40
#: Where all codes are checked: rows in a block of the codes and of the queries, and the least number of blocks of codes.
INDEX_BLOCK, QUERY_BLOCK, LEAST_BLOCKS = 4096, 16_384, 24


@dataclass(frozen=True)
class Model:
    """codes: sign((v - mean) @ rotation). radii[i]: the radius for the distance edges[i]."""

    mean: np.ndarray
    rotation: np.ndarray
    edges: np.ndarray
    radii: np.ndarray
    sample: np.ndarray
    copies: np.ndarray

    def codes(self, v: np.ndarray) -> np.ndarray:
        bits = (v - self.mean) @ self.rotation > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def radius(self, distance: np.ndarray) -> np.ndarray:
        """None at distance 0, all bits beyond the last edge, and in between on the line from one edge's radius to the next one's."""
        if not len(self.radii):
            return np.where(distance > 0, BITS, 0)
        out = np.where(distance > self.edges[-1], BITS, np.ceil(np.interp(distance, self.edges, self.radii)))
        return np.where(distance > 0, out, 0)

    def bound(self, v: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
        """An upper bound on the distance of each query's k-th neighbour, from the sample; infinite where that has too few."""
        out = np.full(len(v), np.inf)
        for s in range(0, len(v), 256):
            d = distances(v[s : s + 256], self.sample)
            order = np.argsort(d, axis=1, kind="stable")[:, : 4 * k + 4]
            reached = np.cumsum(self.copies[order], axis=1) > k  # one more than k: the query itself may be among them
            some = reached.any(1)
            out[s : s + 256][some] = np.take_along_axis(d, order, 1)[some, reached.argmax(1)[some]]
        return np.where(copies > k, 0.0, out)


def distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean, by the inner product: for bounds and samples only."""
    return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * (q @ v.T), 0))


def quantization(v: np.ndarray, bits: int = BITS, rounds: int = 25, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation: principal axes, then as many rotations by iterative quantization as make `bits`."""
    rng = np.random.default_rng(seed)
    mean = v.mean(0)
    x = v - mean
    axes = np.linalg.svd(x.T @ x)[0][:, : min(v.shape[1], 64)]
    p, parts = x @ axes, []
    while sum(r.shape[1] for r in parts) < bits:
        r = np.linalg.qr(rng.standard_normal((p.shape[1], p.shape[1])))[0]
        for _ in range(rounds):
            a, _, b = np.linalg.svd(np.where(p @ r > 0, 1.0, -1.0).T @ p)
            r = b.T @ a.T
        parts.append(r)
    return mean, axes @ np.hstack(parts)[:, :bits]


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def substrings(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each substring for n codes."""
    width = min(WIDE, max(NARROW, int(np.log2(max(n, 2)))))
    edges = np.linspace(0, BITS, -(-BITS // width) + 1).astype(int).tolist()
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def values(codes: np.ndarray, subs: list[tuple[int, int]]) -> np.ndarray:
    """The value of each substring (columns) of each code."""
    out = np.empty((len(codes), len(subs)), np.int64)
    for j, (first, bits) in enumerate(subs):
        word, shift = divmod(first, 64)
        part = codes[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            part = part | codes[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = part & np.uint64((1 << bits) - 1)
    return out


def nearness(radius: int, m: int) -> list[int]:
    """How many bits of each of m substrings may differ in a probe, so that no code within the radius is missed; -1: no probe."""
    near, more = divmod(int(radius), m)
    return [near if j <= more else near - 1 for j in range(m)]


def probing(radius: int, subs: list[tuple[int, int]]) -> bool:
    """Whether probes of a radius are few and meet few codes."""
    probes, share = 0, 0.0
    for s, (_, bits) in zip(nearness(radius, len(subs)), subs, strict=True):
        n = sum(comb(bits, i) for i in range(min(s, bits) + 1))
        probes, share = probes + n, share + n / 2**bits
    return probes <= PROBES and share <= PROBED_SHARE


@lru_cache(64)
def flips(bits: int, most: int) -> np.ndarray:
    """Every pattern of at most `most` flipped bits of a substring."""
    return np.array([sum(1 << i for i in some) for n in range(min(most, bits) + 1) for some in combinations(range(bits), n)], np.int64)


def probes(code: np.ndarray, radius: int, subs: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """(substring, values) to look up."""
    own = values(code[None], subs)[0]
    for j, (s, (_, bits)) in enumerate(zip(nearness(radius, len(subs)), subs, strict=True)):
        if s >= 0:
            yield j, own[j] ^ flips(bits, s)


def within(coded: DataFrame, asks: DataFrame, subs: list[tuple[int, int]]) -> DataFrame:
    """(query, id) of all codes (id, code) within the radius of each query (id, code, radius), by probes of the substring index."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint64).reshape(n, -1)
                own = values(codes, subs)
                for j in range(len(subs)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, j, np.int32)), pa.array(own[:, j]), batch.column("id"), *(pa.array(codes[:, w].view(np.int64)) for w in range(BITS // 64))], names=NAMES)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, code, radius in zip(*(batch.column(c).to_pylist() for c in ("id", "code", "radius")), strict=True):
                words = np.frombuffer(code, np.uint64)
                for j, every in probes(words, radius, subs):
                    for s in range(0, len(every), 1 << 14):
                        some = every[s : s + (1 << 14)]
                        same = lambda x, t: pa.array(np.full(len(some), x, t))  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([same(j, np.int32), pa.array(some), same(i, np.int64), same(radius, np.int32), *(same(w, np.int64) for w in words.view(np.int64))], names=ASKED)

    words = [f"w{n}" for n in range(BITS // 64)]
    NAMES, ASKED = ["sub", "value", "id", *words], ["sub", "value", "query", "radius", *(f"q{w}" for w in words)]
    kind = lambda names: ", ".join(f"{n} {'int' if n in ('sub', 'radius') else 'long'}" for n in names)
    table = materialize(coded.select("id", "code").mapInArrow(index, kind(NAMES)), "ann-substrings")
    looked_up = asks.select("id", "code", "radius").mapInArrow(ask, kind(ASKED))
    differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"q{w}"))) for w in words), F.lit(0))
    return looked_up.join(table, ["sub", "value"]).where(differ <= F.col("radius")).select("query", "id").distinct()


def able(embeddings: DataFrame) -> DataFrame:
    """The rows that take part: vec_id, vec."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("vec", lambda x: x != 0))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """The distinct vectors: vec, members (the k + 1 smallest ids in order)."""
    # a ranking with a bound: every task keeps k + 1 ids of a vector before they are shuffled
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    return rows.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("members"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def fit(index: DataFrame, k: int) -> Model:
    """From SAMPLE entries at most, chosen by a hash of the id."""
    n = index.count()  # first a share of all entries by hash, about twice the sample, so that no task sorts more
    share = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, 2 * SAMPLE / max(1, n)) * (1 << 30))
    got = index.select("vec", F.size("members").alias("copies"), "id").where(share).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    v, copies = matrix(got.column("vec")), got.column("copies").to_numpy()
    mean, rotation = quantization(v)
    model = Model(mean, rotation, np.zeros(0), np.zeros(0), v, copies)
    codes, some = model.codes(v), np.arange(min(SAMPLE_QUERIES, len(v)))
    d, h = distances(v[some], v), hamming(codes[some], codes)
    near = np.argsort(d, axis=1)[:, 1 : 8 * k + 1]
    d, h = np.take_along_axis(d, near, 1).ravel(), np.take_along_axis(h, near, 1).ravel()
    if len(d) < 200:
        return Model(mean, rotation, np.zeros(0), np.zeros(0), v, copies)
    order = np.argsort(d, kind="stable")
    d, h = d[order], h[order]
    ends = np.append(np.arange(STEP, len(d), STEP), len(d))  # pairs up to each edge; the last WINDOW of them say what radius it needs
    radii = np.maximum.accumulate([np.quantile(h[max(0, e - WINDOW) : e], SHARE, method="higher") for e in ends])
    return Model(mean, rotation, d[ends - 1], radii, v, copies)


def search(embeddings: DataFrame, queries, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which `queries` (a column) is true.

    An id that has several vectors is one candidate, by its nearest, and one query, by the nearest to any of its vectors.
    """
    rows = able(embeddings)
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return search_lengths(rows, queries, k)
    rows = materialize(rows.distinct(), "ann-rows")
    total, ids = rows.agg(F.count("*"), F.countDistinct("vec_id")).collect()[0]
    asked, wide, done = rows.where(queries).select(F.col("vec_id").alias("query_id")).distinct(), 2 * k, None
    while True:  # lists of vectors grow until they hold k ids; only queries that are short ask again
        flagged = rows.join(asked.select(F.col("query_id").alias("vec_id"), F.lit(True).alias("asks")), "vec_id", "left")
        lists = search_lengths(flagged, F.coalesce("asks", F.lit(False)), wide).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        found = materialize(lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ann-lists")
        full = found.groupBy("query_id").count().where(F.col("count") >= min(k, ids - 1)).select("query_id")
        last = wide > total
        kept = found if last else found.join(full, "query_id", "left_semi").select(*found.columns)
        done = kept if done is None else done.unionByName(kept)
        asked = materialize(asked.join(full, "query_id", "left_anti"), "ann-short")
        if last or asked.isEmpty():
            return done
        wide *= 4


def search_lengths(rows: DataFrame, queries, k: int) -> DataFrame:
    """search() over vectors of any lengths, each id and vector apart."""
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows")).orderBy("n").collect():  # a row a length
        out = out.unionByName(search_length(rows.where(F.size("vec") == r.n), queries, k))
    return out


def search_length(rows: DataFrame, queries, k: int) -> DataFrame:
    """search() over vectors (vec_id, vec) of one length."""
    spark = rows.sparkSession
    index = materialize(entries(rows, k).withColumn("id", F.monotonically_increasing_id()), "ann-entries")  # numbers are written with their vectors
    shared = spark.sparkContext.broadcast(fit(index, k))  # a bounded sample and a square matrix

    def encode():
        return lambda batch: [batch.column("id"), batch.column("vec"), batch.column("members"), [c.tobytes() for c in shared.value.codes(matrix(batch.column("vec")))]]

    coded = materialize(map_batches(index.select("id", "vec", "members"), encode, "id long, vec array<double>, members array<long>, code binary"), "ann-index")
    n = coded.count()
    subs = substrings(n)

    def reach():
        def run(batch):
            own, q = shared.value, matrix(batch.column("vec"))
            radius = own.radius(own.bound(q, batch.column("copies").to_numpy(), k)).astype(int).tolist()
            return [batch.column("id"), batch.column("vec"), [c.tobytes() for c in own.codes(q)], radius, [probing(r, subs) for r in radius]]

        return run

    asked = materialize(rows.where(queries).select(F.col("vec_id").alias("query_id"), "vec").distinct().join(index.select("vec", "id", F.size("members").alias("copies")), "vec").select("query_id", "id", "copies", "vec"), "ann-queries")
    distinct_queries = asked.groupBy("id").agg(F.first("vec").alias("vec"), F.first("copies").alias("copies"))
    asks = materialize(map_batches(distinct_queries.select("id", "vec", "copies"), reach, "id long, vec array<double>, code binary, radius int, probing boolean"), "ann-asks")
    parts = []
    if not (probers := asks.where("probing")).isEmpty():
        pairs = within(coded, probers, subs)
        near = pairs.join(coded.select("id", "members", "vec"), "id").join(probers.select(F.col("id").alias("query"), F.col("vec").alias("asked")), "query")
        score = F.sqrt(F.aggregate(F.zip_with("vec", "asked", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        parts.append(near.select(F.col("query").alias("id"), F.explode("members").alias("vec_id"), score.alias("score")))
    if not (others := asks.where("not probing")).isEmpty():
        parts.append(checked(coded, n, others, k))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    best = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    nearest = materialize(best(found), "ann-nearest")
    # a radius that holds too few is grown to all bits
    most = min(k + 1, coded.agg(F.sum(F.size("members")).alias("n")).collect()[0].n)
    held = nearest.groupBy("id").agg(F.count("*").alias("held"))
    short = asks.join(held, "id", "left").where(F.coalesce("held", F.lit(0)) < most).drop("held").withColumn("radius", F.lit(BITS))
    short = materialize(short, "ann-short")
    if not short.isEmpty():
        nearest = nearest.join(short.select("id"), "id", "left_anti").unionByName(best(checked(coded, n, short, k)))
    # a query's list holds k + 1 rows, itself among them or not; without it k are left
    found = asked.select("query_id", "id").join(nearest, "id").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def checked(coded: DataFrame, n: int, asks: DataFrame, k: int) -> DataFrame:
    """(id, vec_id, score): for each query the k + 1 nearest, in each block of codes, of those within its radius. Blocks of queries meet blocks of codes."""
    blocks, query_blocks = max(LEAST_BLOCKS, -(-n // INDEX_BLOCK)), max(1, -(-asks.count() // QUERY_BLOCK))
    left = coded.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asks.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def meet(rows: pa.Table, some: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if rows.num_rows and some.num_rows:
            v, q = matrix(rows.column("vec")), matrix(some.column("vec"))
            codes, asked = (np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint64).reshape(t.num_rows, -1) for t in (rows, some))
            members, radius = rows.column("members").to_pylist(), some.column("radius").to_numpy()
            for at, i in enumerate(some.column("id").to_pylist()):
                near = np.flatnonzero(hamming(asked[at : at + 1], codes)[0] <= radius[at])
                d = np.sqrt(((v[near] - q[at]) ** 2).sum(1))
                best = np.argsort(d, kind="stable")
                if len(best) > k + 1:  # entries tied with the last that can matter stay
                    best = best[: np.searchsorted(d[best], d[best[k]], "right")]
                top = sorted((d[b], m) for b in best.tolist() for m in members[near[b]])[: k + 1]
                for score, m in top:
                    out[0].append(i)
                    out[1].append(m)
                    out[2].append(float(score))
        return pa.table({"id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, "id long, vec_id long, score double")
