"""Best-fit packing with a grouping genetic algorithm on islands.

Documents become token pieces; whole-length pieces fill a sequence each. The others are dealt to
islands of bounded size by a hash. An island's individuals are packings of its pieces. Crossover
takes well-filled bins from one parent and injects them into the other: the pieces that the bins
need are taken from that parent's least filled bins (pieces of equal length are interchangeable,
so nothing is there twice), those bins are dissolved, and the displaced pieces are put back: in
the place of a shorter piece where that fills a bin exactly, else by best fit. Between epochs the
islands' states are written to the shared folder, and the best-filled bins of each migrate, as
patterns of lengths, to the next island of a ring, which injects those patterns that it can fill.
At last islands release their least filled bins, which are packed anew together, in pools of
bounded size.

Defined cases: a null or empty text is one piece, the end token; repeated rows are packed each;
an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from . import bpe

ROOM, END = 2048, 0
#: Pieces of an island, individuals, children in an epoch, epochs, bins that migrate.
ISLAND, POPULATION, CHILDREN, EPOCHS, MIGRANTS = 16_384, 5, 24, 3, 256
#: Islands that a task evolves one after the other, about; their rows are small, so their bytes would put too many into one.
AT_ONCE = 4
#: Bins that an island releases at last, and islands whose releases are packed together.
RELEASED, POOL = 24, 64


def pieces(docs: DataFrame, room: int = ROOM, path: str = bpe.VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: texts as tokens with the end token, longer ones cut; the first piece may be shorter."""

    def rows(_, doc_id, ids):
        data = bpe.pack([*ids, END])
        n, out, start = len(data) // 4, [], 0
        while start < n:
            length = (n - start) % room or min(room, n)
            out.append((doc_id, len(out), start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
            start += length
        return out

    return bpe.encode_rows(docs, rows, "doc_id long, piece int, start long, length long, ids_crc32 long", path)


class Packing:
    """bin_of: the bin of each piece; fill: tokens in each bin."""

    def __init__(self, bin_of: np.ndarray, fill: np.ndarray) -> None:
        self.bin_of, self.fill = bin_of, fill

    @property
    def rank(self) -> tuple[int, int]:
        """Fewer bins are better, then bins filled more unevenly."""
        return len(self.fill), -int((self.fill.astype(np.int64) ** 2).sum())


def best_fit(lengths: np.ndarray, bin_of: np.ndarray, fill: list[int], todo: np.ndarray, room: int) -> Packing:
    """Put the pieces `todo`, in that order, each into the fullest bin that takes it; empty bins vanish."""
    by_rest: list[list[int]] = [[] for _ in range(room + 1)]
    open_ = 0  # bit r: there is a bin with rest r
    for b, f in enumerate(fill):
        if 0 < f < room:
            by_rest[room - f].append(b)
            open_ |= 1 << (room - f)
    for i, n in zip(todo.tolist(), lengths[todo].tolist(), strict=True):
        fits = open_ >> n
        if fits:
            rest = n + (fits & -fits).bit_length() - 1
            b = by_rest[rest].pop()
            if not by_rest[rest]:
                open_ ^= 1 << rest
        else:
            b, rest = len(fill), room
            fill.append(0)
        bin_of[i] = b
        fill[b] += n
        if rest > n:
            by_rest[rest - n].append(b)
            open_ |= 1 << (rest - n)
    filled = np.array(fill, np.int64)
    used = filled > 0
    return Packing((np.cumsum(used) - 1)[bin_of], filled[used])


def descending(lengths: np.ndarray, some: np.ndarray, noise: float, rng: np.random.Generator) -> np.ndarray:
    weight = lengths[some] * (1 + noise * rng.standard_normal(len(some))) if noise else lengths[some]
    return some[np.argsort(-weight, kind="stable")]


def patterns(lengths: np.ndarray, packing: Packing, bins: np.ndarray) -> list[tuple[int, ...]]:
    """The lengths in each of some bins."""
    order = np.argsort(packing.bin_of, kind="stable")
    ends = np.cumsum(np.bincount(packing.bin_of, minlength=len(packing.fill)))
    return [tuple(sorted(lengths[order[e - k : e]].tolist(), reverse=True)) for e, k in zip(ends[bins].tolist(), np.bincount(packing.bin_of, minlength=len(packing.fill))[bins].tolist(), strict=True)]


def inject(lengths: np.ndarray, parent: Packing, wanted: list[tuple[int, ...]], room: int, rng: np.random.Generator, mutate: int = 3) -> Packing:
    """The parent with bins of the wanted patterns: made of pieces from its least filled bins, whose other pieces are put back."""
    loose = np.flatnonzero(parent.fill[parent.bin_of] < room)  # full bins stay
    loose = loose[np.lexsort((parent.fill[parent.bin_of[loose]], lengths[loose]))]
    sizes = lengths[loose]
    first = {int(s): k for s, k in zip(*np.unique(sizes, return_index=True), strict=True)}
    last = {int(s): int(np.searchsorted(sizes, s, "right")) for s in first}
    bin_of, fill = parent.bin_of.copy(), parent.fill.tolist()
    hit = np.zeros(len(fill), bool)
    placed = np.zeros(len(lengths), bool)
    for pattern in wanted:
        need: dict[int, int] = {}
        for n in pattern:
            need[n] = need.get(n, 0) + 1
        if all(n in first and first[n] + k <= last[n] for n, k in need.items()):
            taken = np.concatenate([loose[first[n] : first[n] + k] for n, k in need.items()])
            for n, k in need.items():
                first[n] += k
            hit[parent.bin_of[taken]] = True
            placed[taken] = True
            bin_of[taken] = len(fill)
            fill.append(sum(pattern))
    if mutate:  # a few of the least filled bins are dissolved too
        lowest = np.argsort(parent.fill, kind="stable")[: 8 * mutate]
        hit[rng.choice(lowest, min(mutate, len(lowest)), replace=False)] = True
    displaced = np.flatnonzero(hit[parent.bin_of] & ~placed)
    for b in np.flatnonzero(hit).tolist():
        fill[b] = 0
    displaced = exchange(lengths, parent, hit, placed, bin_of, fill, displaced, room)
    return best_fit(lengths, bin_of, fill, descending(lengths, displaced, 0.02, rng), room)


def exchange(lengths: np.ndarray, parent: Packing, hit: np.ndarray, placed: np.ndarray, bin_of: np.ndarray, fill: list[int], displaced: np.ndarray, room: int) -> np.ndarray:
    """Displaced pieces take the place of shorter ones wherever that fills a bin exactly; returns what is displaced then."""
    rest = room - parent.fill
    able = np.flatnonzero((rest > 0)[parent.bin_of] & ~hit[parent.bin_of] & ~placed)
    fits: dict[int, list[int]] = {}
    for i, need in zip(able.tolist(), (lengths[able] + rest[parent.bin_of[able]]).tolist(), strict=True):
        fits.setdefault(need, []).append(i)
    out, done = [], set()
    for i, n in zip(displaced.tolist(), lengths[displaced].tolist(), strict=True):
        others = fits.get(n, ())
        while others and bin_of[others[-1]] in done:
            others.pop()
        if others:
            other = others.pop()
            b = int(bin_of[other])
            done.add(b)
            bin_of[i], fill[b] = b, room
            out.append(other)
        else:
            out.append(i)
    return np.array(out, np.int64)


def begin(lengths: np.ndarray, room: int, rng: np.random.Generator, population: int = POPULATION) -> list[Packing]:
    every = np.arange(len(lengths))
    return [best_fit(lengths, np.zeros(len(lengths), np.int64), [], descending(lengths, every, 0.04 * n, rng), room) for n in range(population)]


def evolve(lengths: np.ndarray, packings: list[Packing], immigrants: list[tuple[int, ...]], room: int, rng: np.random.Generator, children: int = CHILDREN) -> list[Packing]:
    """One epoch: immigrants first, then crossovers; a child replaces the worst if it is better. Best first."""
    least = -(-int(lengths.sum()) // room)
    packings = sorted(packings, key=lambda p: p.rank)
    for n in range(children):
        if packings[0].rank[0] <= least:
            break
        a, b = (min(rng.choice(len(packings), 2).tolist()) for _ in range(2))
        if n == 0 and immigrants:
            a, wanted = 0, immigrants
        else:
            full = np.argsort(-packings[b].fill, kind="stable")[: max(1, len(packings[b].fill) // 2)]
            wanted = patterns(lengths, packings[b], rng.permutation(full)[: max(1, len(full) // 2)])
        child = inject(lengths, packings[a], wanted, room, rng)
        if child.rank < packings[-1].rank:
            packings[-1] = child
            packings.sort(key=lambda p: p.rank)
    return packings


STATE = "island long, uid binary, length binary, packings array<binary>, elite array<binary>"


def _state(island: int, uid: np.ndarray, lengths: np.ndarray, packings: list[Packing]) -> pa.RecordBatch:
    best = packings[0]
    elite = patterns(lengths, best, np.argsort(-best.fill, kind="stable")[:MIGRANTS])
    columns = [[island], [uid.tobytes()], [lengths.tobytes()], [[p.bin_of.astype(np.int32).tobytes() for p in packings]], [[np.array(e, np.int32).tobytes() for e in elite]]]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["island", "uid", "length", "packings", "elite"])


def _restored(row: dict) -> tuple[np.ndarray, np.ndarray, list[Packing]]:
    lengths = np.frombuffer(row["length"], np.int64)
    bins = [np.frombuffer(b, np.int32).astype(np.int64) for b in row["packings"]]
    return np.frombuffer(row["uid"], np.int64), lengths, [Packing(b, np.bincount(b, weights=lengths).astype(np.int64)) for b in bins]


def pack(table: DataFrame, room: int = ROOM, island: int = ISLAND) -> DataFrame:
    """(uid, sequence_id, offset) for a written table (uid, length) of pieces shorter than a sequence. sequence_ids are even."""
    count = table.count()
    islands = max(1, -(-count // island))
    tasks = -(-islands // AT_ONCE)
    dealt = table.withColumn("island", F.pmod(F.xxhash64("uid"), F.lit(islands)))

    def first(t: pa.Table) -> pa.Table:
        number = t.column("island")[0].as_py()
        uid, lengths = t.column("uid").to_numpy(), t.column("length").to_numpy()
        order = np.argsort(uid)  # as the rows may come in any order
        uid, lengths = uid[order], lengths[order]
        rng = np.random.default_rng(number)
        return pa.Table.from_batches([_state(number, uid, lengths, evolve(lengths, begin(lengths, room, rng), [], room, rng))])

    state = materialize(dealt.repartition(tasks, "island").groupBy("island").applyInArrow(first, STATE), "packing-epoch")
    for epoch in range(1, EPOCHS if islands > 1 else 1):
        guests = state.select(F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("guests"))

        def later(batches: Iterator[pa.RecordBatch], epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    uid, lengths, packings = _restored(row)
                    wanted = [tuple(np.frombuffer(g, np.int32).tolist()) for g in row["guests"] or ()]  # the island before may have no pieces
                    yield _state(row["island"], uid, lengths, evolve(lengths, packings, wanted, room, np.random.default_rng((row["island"], epoch))))

        before, state = state, materialize(state.join(guests, "island", "left").repartition(tasks, "island").mapInArrow(later, STATE), "packing-epoch")
        discard(before)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uid, lengths, packings = _restored(row)
                best = packings[0]
                freed = np.zeros(len(best.fill), bool)
                freed[np.argsort(best.fill, kind="stable")[: RELEASED if islands > 1 else 0]] = True
                order = np.lexsort((uid, best.bin_of))
                before = np.cumsum(lengths[order]) - lengths[order]
                offset = before - np.repeat(before[np.flatnonzero(np.diff(best.bin_of[order], prepend=-1))], np.bincount(best.bin_of))
                bins = best.bin_of[order]
                pool = np.where(freed[bins], row["island"] // POOL, -1)
                columns = [uid[order], lengths[order], np.full(len(uid), row["island"]) + islands * bins, offset, pool]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["uid", "length", "sequence", "offset", "pool"])

    settled = materialize(state.mapInArrow(settle, "uid long, length long, sequence long, offset long, pool long"), "packing-settled")
    done = settled.where("pool < 0").select("uid", (F.col("sequence") * 4).alias("sequence_id"), "offset")
    if islands == 1:
        return done

    def again(t: pa.Table) -> pa.Table:
        uid, lengths = t.column("uid").to_numpy(), t.column("length").to_numpy()
        order = np.argsort(uid)
        uid, lengths = uid[order], lengths[order]
        rng = np.random.default_rng(5)
        best = evolve(lengths, begin(lengths, room, rng), [], room, rng)[0]
        order = np.argsort(best.bin_of, kind="stable")
        bins, before = best.bin_of[order], np.cumsum(lengths[order]) - lengths[order]
        offset = before - np.repeat(before[np.flatnonzero(np.diff(bins, prepend=-1))], np.bincount(bins))
        pool = t.column("pool")[0].as_py()
        sequence = 4 * (pool + (islands // POOL + 1) * bins) + 2
        return pa.table({"uid": pa.array(uid[order]), "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())})

    return done.unionByName(settled.where("pool >= 0").groupBy("pool").applyInArrow(again, "uid long, sequence_id long, offset long"))


def sequences(docs: DataFrame, room: int = ROOM, path: str = bpe.VOCABULARY, island: int = ISLAND) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece. A whole-length piece has an odd sequence_id."""
    made = materialize(pieces(docs, room, path).withColumn("uid", F.monotonically_increasing_id()), "packing-pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = made.where(F.col("length") == room).select(*names[:5], (F.col("uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pieces_ = made.where(F.col("length") < room).select("uid", "length")
    placed = materialize(pack(pieces_, room, island), "packing-placed")
    if (n := placed.count()) != (wanted := pieces_.count()):
        raise RuntimeError(f"{n} of {wanted} pieces have a place")
    return whole.unionByName(made.where(F.col("length") < room).join(placed, "uid").select(*names))
