"""LM scoring with Brown class-based bigrams.

Words are counted over every training text. The most frequent ones are put into classes by
exchange clustering: each word in turn moves to the class that raises the likelihood of the class
bigrams most, on the counts of all texts. Then every other training word, whatever its count, moves from the class of its
shape (length and kinds of characters) to the class that raises that likelihood most, or stays
there where none does; the counts of its neighbours' classes are gathered by word. Words without
training counts have the class of their shape, so any word has a class. A text's probability is
the product of class transitions, counted anew over all classes and smoothed towards the classes'
shares, and of words within classes, one added.

Counts and classes of the HEAD most frequent words travel to the tasks, which bounds that table;
those of all other words are joined in, by word, to the few rows that need them. So no word is
capped and no frequent word is shuffled row by row. Long texts are read, classed and scored in
parts, each after the last word of the one before, so that no task holds all words of a text.

Defined cases: a null or empty text is its end token alone; a null doc_id is not held out; with no
training text all counts are zero; repeated rows count and are scored one by one; an empty table
gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import discard, materialize
from .common import held_out, map_batches

SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Words whose counts every task holds, and their bytes, at most.
HEAD, HEAD_BYTES = 200_000, 8 << 20
#: Words that are exchanged in turn, and the classes that all training words may go to.
CLUSTERED, CLASSES, SWEEPS = 4096, 48, 6
#: What a rare word's class must gain over that of its shape (nats), so that a chance neighbour doesn't decide.
COST = 2.0
#: A sweep that moves no more than this share of the words is the last.
STILL = 0.002
#: Classes by shape: four lengths times four kinds of characters; then the class of the end token.
SHAPES = 16
END_TYPE = CLUSTERED + SHAPES
TYPES = END_TYPE + 1
END_CLASS = CLASSES + SHAPES
#: Neighbours of a word: the classes, and the word itself.
NEIGHBOURS = END_CLASS + 2
CONTEXT = np.dtype([("at", "u1"), ("n", "<u4")])
#: Weight of the classes' shares in the smoothed transitions.
SMOOTHING = 20.0
#: Bytes of text that are split at once.
PART = 256 << 10
#: Distinct words, or bytes of all words, that a task reads before it hands on its counts; rows that it hands on at once.
FLUSH, FLUSH_BYTES, ROWS = 200_000, 64 << 20, 10_000
#: Neighbours a task holds before it hands on their counts, and words whose classes are chosen at once.
HELD, SOME = 3_000_000, 500
#: The id of a text's ends, and the columns that the passes over the parts read.
END_ID, READ = -(1 << 31), ("ids", "shapes", "rare", "part", "last")
#: All words differ: dictionary pages would only take memory.
NO_DICTIONARY = {"parquet.enable.dictionary": "false"}


def words_in(text: str | None) -> Iterator[list[bytes]]:
    """Lower-cased (A-Z only) words, in lists of those of about PART bytes of text; bytes split at ASCII white space only."""
    data, start = text.encode().lower() if text else b"", 0
    while len(data) - start > PART:
        space = SPACE.search(data, start + PART)
        end = space.start() if space else len(data)
        yield data[start:end].split()
        start = end
    if words := data[start:].split():
        yield words


def shape(word: bytes) -> int:
    n = len(word)
    size = 0 if n < 4 else 4 if n < 7 else 8 if n < 11 else 12
    return size + (0 if word.isalpha() else 1 if not word.isascii() else 2 if len(word.translate(None, b"0123456789")) < n else 3)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts; each task sums before it hands on, in the middle of a text too."""

    def out(held: Counter) -> Iterator[pa.RecordBatch]:
        pairs = iter(held.items())
        while some := list(islice(pairs, ROWS)):
            words, counts = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, read = Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                for words in words_in(text.as_py()):
                    held.update(words)
                    read += sum(map(len, words))  # no fewer bytes than those of the words held
                    if len(held) >= FLUSH or read >= FLUSH_BYTES:
                        yield from out(held)
                        held.clear()
                        read = 0
        yield from out(held)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Head:
    """The most frequent words in order, space-joined, with their counts and shapes. A word is its place here; the first CLUSTERED are clustered."""

    words: bytes
    counts: np.ndarray
    shapes: np.ndarray
    table: dict = field(default=None, repr=False)

    def __getstate__(self):
        return {"words": self.words, "counts": self.counts, "shapes": self.shapes, "table": None}

    def index(self) -> dict[bytes, int]:
        """The place of each word; made once a worker."""
        if self.table is None:
            self.table = {w: n for n, w in enumerate(self.words.split())}
        return self.table


def frequent(vocabulary: DataFrame, most: int = HEAD, most_bytes: int = HEAD_BYTES) -> Head:
    """The most frequent words, about `most` and `most_bytes` of them at most. The least count comes from a histogram, so no task sees more words
    than the head has; of the histogram's next step a share by hash comes along, so that many words of equal counts fill the head too."""
    step, draw = F.floor(F.log2(F.col("c").cast("double")) * 16), F.pmod(F.xxhash64("word"), F.lit(1 << 30))
    wanted, n, size = F.lit(True), 0, 0
    for r in sorted(vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum(F.octet_length("word") + 1).alias("bytes")).collect(), reverse=True):  # 16 rows an octave
        share = min(1.0, (most - n) / r.n, (most_bytes - size) / r.bytes)
        if share < 1:
            wanted = (step > r.step) | ((step == r.step) & (draw < int(share * (1 << 30))))
            break
        n, size = n + r.n, size + r.bytes
    got = vocabulary.where(wanted).toArrow()
    words, counts = got.column("word").to_pylist(), got.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
    return Head(b" ".join([words[i] for i in order]), counts[order] if order else np.zeros(0, np.int64), np.array([shape(words[i]) for i in order], np.uint8))


class Numbers(dict):
    """Words by their number, in the order in which they came."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


PARTS = "doc_id long, held_out boolean, key long, part int, last boolean, n_words long, known long, counted double, ids binary, rare array<binary>, times array<long>, shapes binary"


def numbered(batches: Iterator[pa.RecordBatch], head: Head, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """PARTS of texts (doc_id, held_out, key, text): for each list of words_in(), one at least, the places of its words after that of the word
    before them, four bytes each, and -1 - n for the n-th of the words outside the head; these, how often they come, and their shapes; how
    many words are in the head, and the sum of log10(count + 1) of those."""
    get, log_count = head.index().get, np.append(np.log10(head.counts + 1.0), 0.0)

    def row(lead: list[bytes], words: list[bytes]) -> tuple:
        every, numbers = [*lead, *words], Numbers()
        ids = np.fromiter(map(get, every, repeat(-1)), np.int32, len(every))
        outside = np.flatnonzero(ids < 0)
        which = np.array([numbers[every[n]] for n in outside.tolist()], np.int64)
        mine = ids[len(lead) :]
        known, counted = int((mine >= 0).sum()), float(log_count[mine].sum())
        ids[outside] = -1 - which
        times = np.bincount(which[outside >= len(lead)], minlength=len(numbers)).tolist()
        return len(words), known, counted, ids.tobytes(), list(numbers), times, bytes(map(shape, numbers))

    for batch in batches:
        out: list[tuple] = []
        held = 0
        for doc_id, apart, key, text in zip(*(batch.column(n) for n in ("doc_id", "held_out", "key", "text")), strict=True):
            own, lead, part, now = (doc_id.as_py(), apart.as_py(), key.as_py()), [], 0, []
            for words in chain(words_in(text.as_py()), [None]):
                if part or words is None:  # the list before this one, now that it is known whether it is the last
                    out.append((*own, part - 1 if part else 0, words is None, *row(lead, now)))
                    held += len(now)
                    lead = now[-1:]
                if words is not None:
                    now, part = words, part + 1
                if held >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)


def parts_of(rows: DataFrame, head) -> DataFrame:
    """The written parts of the texts of rows (doc_id, text, held_out), each with a number `row`. head: a broadcast Head."""
    kind = T._parse_datatype_string(PARTS)
    keyed = rows.select("doc_id", "text", "held_out", F.monotonically_increasing_id().alias("key"))
    made = keyed.mapInArrow(lambda batches: numbered(batches, head.value, to_arrow_schema(kind)), PARTS)
    return materialize(made.withColumn("row", F.monotonically_increasing_id()), "brown-parts", compression="zstd", **NO_DICTIONARY)


def placed(batches: Iterator[pa.RecordBatch], of_place: np.ndarray, of_shape: np.ndarray, end: int) -> Iterator[tuple]:
    """The ids of each part, and a value for each of its words: by place, or by shape outside the head. The text's ends are ids of -(1 << 31) and
    have the value `end`."""
    for batch in batches:
        for ids, shapes, rare, part, last in zip(*(batch.column(n) for n in ("ids", "shapes", "rare", "part", "last")), strict=True):
            ids = np.frombuffer(ids.as_py(), np.int32)
            values = of_place[np.maximum(ids, -1)]  # of words outside the head the last, put right below
            outside = np.flatnonzero(ids < 0)
            if len(outside):
                values[outside] = of_shape[np.frombuffer(shapes.as_py(), np.uint8)][-1 - ids[outside]]
            first, after = [END_ID] * (part.as_py() == 0), [END_ID] * last.as_py()
            yield np.concatenate([first, ids, after]).astype(np.int64), np.concatenate([[end] * len(first), values, [end] * len(after)]).astype(np.int64), rare




Bigrams = tuple[np.ndarray, np.ndarray, np.ndarray]  # types, the types that follow, counts; each pair once, in order


def merged(raw: list[np.ndarray], key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their counts, with one more for each raw key."""
    fresh, times = np.unique(np.concatenate([key[:0], *raw]), return_counts=True)
    every, at = np.unique(np.concatenate([key, fresh]), return_inverse=True)
    return every, np.bincount(at, weights=np.concatenate([n, times]), minlength=len(every)).astype(np.int64)


def count_bigrams(parts: DataFrame, head) -> Bigrams:
    """Counts of neighbouring types in all texts, each between two end tokens. head: a broadcast Head."""

    def out(pair: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(pair), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pair[s : s + (1 << 16)]), pa.array(n[s : s + (1 << 16)])], names=["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_of = CLUSTERED + head.value.shapes.astype(np.int64)
        type_of[:CLUSTERED] = np.arange(len(type_of[:CLUSTERED]))
        raw, size, pair, n = [], 0, np.zeros(0, np.int32), np.zeros(0, np.int64)
        for _, t, _ in placed(batches, np.append(type_of, 0), CLUSTERED + np.arange(SHAPES), END_TYPE):
            raw.append((t[:-1] * TYPES + t[1:]).astype(np.int32))
            size += len(t) - 1
            if size >= HELD:
                pair, n = merged(raw, pair, n)
                raw, size = [], 0
                if len(pair) >= HELD:
                    yield from out(pair, n)
                    pair, n = pair[:0], n[:0]
        yield from out(*merged(raw, pair, n))

    got = parts.select(*READ).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # TYPES squared rows at most, whatever the corpus
    pair = got.column("pair").to_numpy().astype(np.int64)
    order = np.argsort(pair)
    return pair[order] // TYPES, pair[order] % TYPES, got.column("n").to_numpy()[order]


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def class_table(bigrams: Bigrams, own: np.ndarray, size: int) -> np.ndarray:
    row, col, n = bigrams
    return np.bincount(own[row] * size + own[col], weights=n, minlength=size * size).reshape(size, size)


def exchange(bigrams: Bigrams, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each type: exchange clustering of the first CLUSTERED ones, fixed classes for the others."""
    row, col, n = bigrams[0], bigrams[1], bigrams[2].astype(float)
    fixed = TYPES - CLUSTERED
    own = np.concatenate([np.arange(CLUSTERED) % classes, classes + np.arange(fixed)])
    size = classes + fixed
    table = class_table((row, col, n), own, size)
    # each type's counts towards and from each class, and its pairs by the one and by the other side
    outward = np.bincount(row * size + own[col], weights=n, minlength=TYPES * size).reshape(TYPES, size)
    inward = np.bincount(col * size + own[row], weights=n, minlength=TYPES * size).reshape(TYPES, size)
    places = np.arange(TYPES + 1)
    from_, back = np.searchsorted(row, places), np.argsort(col, kind="stable")
    to_, k = np.searchsorted(col[back], places), np.arange(classes)
    loops = np.zeros(TYPES)
    loops[row[row == col]] = n[row == col]
    used = np.flatnonzero((outward.sum(1) + inward.sum(1))[:CLUSTERED] > 0)
    for _ in range(sweeps):
        moved = 0
        for w in used.tolist():
            a, self_ = own[w], loops[w]
            o, i = outward[w].copy(), inward[w].copy()
            o[a] -= self_
            i[a] -= self_
            table[a] -= o
            table[:, a] -= i
            table[a, a] -= self_
            rows, columns = table.sum(1) + i, table.sum(0) + o  # what words of a class send and get, w's share included
            so, si = np.flatnonzero(o), np.flatnonzero(i)
            after, before = table[:classes, so], table[si, :classes]
            gain = (_g(after + o[so]) - _g(after)).sum(1) + (_g(before + i[si, None]) - _g(before)).sum(0)
            d = table[k, k]
            gain += _g(d + o[k] + i[k] + self_) - _g(d + o[k]) - _g(d + i[k]) + _g(d)
            wo, wi = o.sum() + self_, i.sum() + self_
            gain -= _g(rows[k] + wo) - _g(rows[k]) + _g(columns[k] + wi) - _g(columns[k])
            b = int(gain.argmax()) if gain.max() > gain[a] + 1e-9 else a
            table[b] += o
            table[:, b] += i
            table[b, b] += self_
            if b != a:
                moved += 1
                own[w] = b
                at = back[to_[w] : to_[w + 1]]
                outward[row[at], a] -= n[at]
                outward[row[at], b] += n[at]
                at = slice(from_[w], from_[w + 1])
                inward[col[at], a] -= n[at]
                inward[col[at], b] += n[at]
        if moved <= STILL * len(used):
            break
    return own


def contexts(batches: Iterator[pa.RecordBatch], head: Head, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(word, contexts) of each word that is not clustered: a binary of CONTEXT records each time the task hands on, counts of NEIGHBOURS that
    follow and then of those that precede. own: the class of each type."""
    frequent_words, many = head.words.split(), len(head.counts)
    least, class_of = min(many, CLUSTERED), CLASSES + head.shapes  # words are numbered by place, those outside the head from there on
    class_of[:CLUSTERED] = own[: len(class_of[:CLUSTERED])]

    def out(numbers: Numbers, keys: list) -> Iterator[pa.RecordBatch]:
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        word, first = np.unique(key // (2 * NEIGHBOURS), return_index=True)
        data = np.empty(len(key), CONTEXT)
        data["at"], data["n"] = key % (2 * NEIGHBOURS), n
        rare, ends = list(numbers), np.append(first, len(key))
        for s in range(0, len(word), ROWS):
            some = word[s : s + ROWS]
            offsets = ends[s : s + len(some) + 1]
            held = data[offsets[0] : offsets[-1]].tobytes()
            at = ((offsets - offsets[0]) * CONTEXT.itemsize).astype(np.int32)
            made = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(held)])
            yield pa.RecordBatch.from_arrays([pa.array([frequent_words[i] if i < many else rare[i - many] for i in some.tolist()], pa.binary()), made], names=["word", "contexts"])

    numbers, keys, size = Numbers(), [], 0
    for ids, c, rare in placed(batches, np.append(class_of, 0), CLASSES + np.arange(SHAPES), END_CLASS):
        outside = np.flatnonzero((ids < 0) & (ids != END_ID))
        if len(outside):
            ids[outside] = many + np.fromiter(map(numbers.__getitem__, rare.as_py()), np.int64, len(rare.values))[-1 - ids[outside]]
        same = ids[1:] == ids[:-1]
        a, b = np.flatnonzero(ids[:-1] >= least), np.flatnonzero(ids[1:] >= least)
        after = ids[a] * (2 * NEIGHBOURS) + np.where(same[a], END_CLASS + 1, c[a + 1])
        before = ids[b + 1] * (2 * NEIGHBOURS) + NEIGHBOURS + np.where(same[b], END_CLASS + 1, c[b])
        keys += [after.astype(np.int32), before.astype(np.int32)]
        size += len(a) + len(b)
        if size >= HELD or len(numbers) >= FLUSH:
            if size:
                yield from out(numbers, keys)
            numbers, keys, size = Numbers(), [], 0
    if size:
        yield from out(numbers, keys)


def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and their summed contexts, from rows in order of the words; as many rows as a word has are read one after the other."""
    kept, rest = None, np.zeros(2 * NEIGHBOURS)
    for batch in batches:
        if not batch.num_rows:
            continue
        runs, column = pc.run_end_encode(batch.column("word")), batch.column("contexts")
        words, ends = runs.values.to_pylist(), runs.run_ends.to_numpy().astype(np.int64)
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // CONTEXT.itemsize
        data = np.frombuffer(column.buffers()[2], CONTEXT, count=int(at[-1]))
        starts = at[np.append(0, ends)]  # the records of each word
        for s in range(0, len(words), SOME):
            part = words[s : s + SOME]
            edges = starts[s : s + len(part) + 1]
            records = data[edges[0] : edges[-1]]
            which = np.repeat(np.arange(len(part)), np.diff(edges))
            seen = np.bincount(which * 2 * NEIGHBOURS + records["at"], weights=records["n"], minlength=len(part) * 2 * NEIGHBOURS).reshape(len(part), -1)
            if kept == part[0]:
                seen[0] += rest
            elif kept is not None:
                part, seen = [kept, *part], np.vstack([rest, seen])
            kept, rest = part[-1], seen[-1].copy()
            if len(part) > 1:
                yield part[:-1], seen[:-1]
    if kept is not None:
        yield [kept], rest[None]


def best_class(table: np.ndarray, own: np.ndarray, after: np.ndarray, before: np.ndarray, same: np.ndarray, cost: float = COST) -> np.ndarray:
    """For each word of the classes own (of shapes) that one to join, of the clustered classes and own, with which the class bigrams are likeliest.

    table: class bigrams with each word in its own class; after, before: each word's neighbours by class, besides itself; same: itself.
    """
    k = CLASSES
    t, rows, columns = table[:k, :k].diagonal(), table.sum(1), table.sum(0)
    n, at = len(own), np.arange(len(own))
    gain = np.zeros((n, k + 1))
    stay = np.zeros(n)
    for mine, other, to in ((after, before, table), (before, after, table.T)):
        r, c = np.nonzero(mine)
        x = mine[r, c][:, None]
        held = to[:k, c].T.copy()
        back = c == own[r]
        held[back] -= other[r[back], :k]  # the word itself no longer stands in its own class
        part = _g(held + x) - _g(held)
        inner = np.flatnonzero(c < k)
        part[inner, c[inner]] = 0  # within a class both ways count at once, below
        which, first = np.unique(r, return_index=True)
        if len(which):
            gain[which, :k] += np.add.reduceat(part, first)
        was = to[own[r], c]
        np.add.at(stay, r, np.where(back, 0, _g(was) - _g(was - x[:, 0])))
    both = after[:, :k] + before[:, :k] + same[:, None]
    gain[:, :k] += _g(t + both) - _g(t)
    d = table[own, own]
    stay += _g(d) - _g(d - after[at, own] - before[at, own] - same)
    for total, sums in ((after.sum(1) + same, rows), (before.sum(1) + same, columns)):
        gain[:, :k] -= _g(sums[:k] + total[:, None]) - _g(sums[:k])
        stay -= _g(sums[own]) - _g(sums[own] - total)
    gain[:, k] = stay + cost
    best = gain.argmax(1)
    return np.where(best == k, own, best)


def cluster(parts: DataFrame, head) -> DataFrame:
    """(word, c, class) of all words of the training texts' parts."""
    bigrams = count_bigrams(parts, head)
    own = exchange(bigrams)
    table = class_table(bigrams, own, END_CLASS + 1)
    clustered = head.value.words.split()[:CLUSTERED]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, seen in by_word(batches):
            after, before, same = seen[:, : END_CLASS + 1], seen[:, NEIGHBOURS : NEIGHBOURS + END_CLASS + 1], seen[:, END_CLASS + 1]
            classes = best_class(table, np.array([CLASSES + shape(w) for w in words], np.int64), after, before, same)
            counts = (after.sum(1) + same).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts), pa.array(classes.astype(np.int32))], names=["word", "c", "class"])

    schema = "word binary, c long, class int"
    seen = parts.select(*READ).mapInArrow(lambda batches: contexts(batches, head.value, own), "word binary, contexts binary")
    rest = seen.repartition("word").sortWithinPartitions("word").mapInArrow(assign, schema)
    first = parts.sparkSession.createDataFrame([(bytearray(w), int(c), int(k)) for w, c, k in zip(clustered, head.value.counts.tolist(), own.tolist(), strict=False)], schema)
    return materialize(rest.unionByName(first), "brown-classes", **NO_DICTIONARY)


def head_classes(classed: DataFrame, head) -> np.ndarray:
    """The class of each word of the head, in its order."""

    def make():
        get = head.value.index().get

        def run(batch):
            ids = [get(w, -1) for w in batch.column("word").to_pylist()]
            there = [n for n, i in enumerate(ids) if i >= 0]
            return [[ids[n] for n in there], batch.column("class").take(pa.array(there, pa.int64()))]

        return run

    got = map_batches(classed, make, "place int, class int").toArrow()
    out = np.zeros(len(head.value.counts) + 1, np.uint8)  # the last: words outside the head
    out[got.column("place").to_numpy()] = got.column("class").to_numpy()
    return out


SEQUENCE = "doc_id long, held_out boolean, key long, part int, last boolean, n_words long, n_known long, counted double, classes binary"


def sequences(parts: DataFrame, classed: DataFrame, head) -> DataFrame:
    """SEQUENCE of written parts: n_known and counted (sum of log10(count + 1)) of the part's own words, and the classes of all, a byte each."""
    classes = parts.sparkSession.sparkContext.broadcast(head_classes(classed, head))
    rare = parts.select("row", F.posexplode(F.arrays_zip("rare", "times")).alias("at", "r")).select("row", "at", F.col("r.rare").alias("word"), F.col("r.times").alias("n"))
    found = rare.join(classed, "word").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("n"))).alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_counted"), F.collect_list(F.struct("at", "class")).alias("found")
    )

    def fill():
        class_of = classes.value

        def run(batch):
            out = []
            for ids, shapes, found in zip(*(batch.column(n) for n in ("ids", "shapes", "found")), strict=True):
                ids = np.frombuffer(ids.as_py(), np.int32)
                c = class_of[np.maximum(ids, -1)]
                outside = np.flatnonzero(ids < 0)
                if len(outside):
                    to = CLASSES + np.frombuffer(shapes.as_py(), np.uint8)  # without training counts the class is that of the shape
                    if found.is_valid and len(found.values):
                        to[found.values.field("at").to_numpy()] = found.values.field("class").to_numpy()
                    c[outside] = to[-1 - ids[outside]]
                out.append(c.tobytes())
            return [*(batch.column(n) for n in ("doc_id", "held_out", "key", "part", "last", "n_words", "n_known", "counted")), out]

        return run

    joined = parts.drop("rare", "times").join(found, "row", "left")
    joined = joined.withColumn("n_known", F.col("known") + F.coalesce("rare_known", F.lit(0))).withColumn("counted", F.col("counted") + F.coalesce("rare_counted", F.lit(0.0)))
    joined = joined.select("doc_id", "held_out", "key", "part", "last", "n_words", "n_known", "counted", "ids", "shapes", "found")
    return materialize(map_batches(joined, fill, SEQUENCE), "brown-sequences")


def between_ends(classes: bytes, part: int, last: bool) -> np.ndarray:
    """The classes of a part with an end token before the text's first and after its last."""
    return np.concatenate([[END_CLASS] * (part == 0), np.frombuffer(classes, np.uint8), [END_CLASS] * last]).astype(np.int64)


@dataclass
class Model:
    """transition: log10 P(class | class); room: log10(tokens + words + 1) of each class."""

    transition: np.ndarray
    room: np.ndarray
    tokens: int
    words: int
    docs: int


def transitions(train: DataFrame, classed: DataFrame, docs: int) -> Model:
    """From the sequences of the training texts."""
    size = END_CLASS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for classes, part, last in zip(*(batch.column(n).to_pylist() for n in ("classes", "part", "last")), strict=True):
                c = between_ends(classes, part, last)
                total += np.bincount(c[:-1] * size + c[1:], minlength=size * size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["pair", "n"])

    table = np.zeros(size * size)
    for r in train.select("classes", "part", "last").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # size squared rows at most
        table[r.pair] = r.n
    table = table.reshape(size, size)
    share = (table.sum(0) + 1) / (table.sum() + size)
    transition = np.log10((table + SMOOTHING * share) / (table.sum(1, keepdims=True) + SMOOTHING))
    tokens, distinct = np.zeros(size), np.zeros(size)
    for r in classed.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("words")).collect():
        tokens[r["class"]], distinct[r["class"]] = r.c, r.words
    tokens[END_CLASS], distinct[END_CLASS] = docs, min(docs, 1)
    return Model(transition, np.log10(tokens + distinct + 1), int(tokens.sum()), int(distinct.sum()), docs)


def fit(train: DataFrame, head, docs: int) -> Model:
    rows = train.select("doc_id", F.col("text").cast("string").alias("text"), F.lit(False).alias("held_out"))
    parts = parts_of(rows, head)
    classed = cluster(parts, head)
    return transitions(sequences(parts, classed, head), classed, docs)


def score(docs: DataFrame) -> DataFrame:
    """The contract's columns, and perplexity (10 to the mean negative log10 probability of a token)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out("doc_id", 7, 2).alias("held_out"))
    train = rows.where("not held_out")
    n_docs = train.select("held_out").count()
    vocabulary = materialize(count_words(train), "brown-words", **NO_DICTIONARY)
    head = spark.sparkContext.broadcast(frequent(vocabulary))
    discard(vocabulary)
    numbered_parts = parts_of(rows, head)
    classed = cluster(numbered_parts.where("not held_out"), head)
    parts = sequences(numbered_parts, classed, head)
    discard(numbered_parts)
    m = transitions(parts.where("not held_out"), classed, n_docs)
    transition, room = m.transition, m.room

    def make():
        def run(batch):
            fixed = []
            for classes, part, last in zip(*(batch.column(n).to_pylist() for n in ("classes", "part", "last")), strict=True):
                c = between_ends(classes, part, last)
                fixed.append(float(transition[c[:-1], c[1:]].sum() - room[c[1:]].sum()))
            return [*(batch.column(n) for n in ("doc_id", "held_out", "key", "n_words", "n_known", "counted")), fixed]

        return run

    whole = (F.col("part") == 0) & F.col("last")
    one, several = (map_batches(parts.where(x), make, "doc_id long, held_out boolean, key long, n_words long, n_known long, counted double, fixed double") for x in (whole, ~whole))
    joined = several.groupBy("key").agg(*(F.first(c).alias(c) for c in ("doc_id", "held_out")), *(F.sum(c).alias(c) for c in ("n_words", "n_known", "counted", "fixed")))
    scored = one.unionByName(joined).withColumn("n_tokens", F.col("n_words") + 1)
    counted = F.col("counted") + float(np.log10(m.docs + 1.0))
    score_ = counted + F.col("fixed")
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + int(m.docs > 0)).alias("n_known"), F.lit(m.tokens).cast("long").alias("train_tokens"),
        (counted - F.col("n_tokens") * float(np.log10(m.tokens + m.words + 1))).alias("base_score"), score_.alias("score"), F.pow(F.lit(10.0), -score_ / F.col("n_tokens")).alias("perplexity"),
    )
