"""Cross-tokenizer alignment by segment deduplication.

Two tokenizers cut a text's bytes in different places. Here a text is first cut into segments, only
in front of white space that no token of either vocabulary joins to what stands before it (cuts()
reads both vocabularies to find such characters). So the tokens of a text are those of its segments,
one after the other, and both tokenizers end a token at every cut. Each distinct segment of the
whole corpus is tokenized and aligned once; documents are composed of their segments' alignments.

Documents are gathered in batches of bounded size. A batch has a list of its distinct segments and,
for each document, their numbers; a segment comes to the joins once a batch, however common it is.
The list is written in rows of PART segments, so no row that the JVM holds grows with the batch's list:

    batches -> distinct segments, counted -> aligned once -> linked pairs, counted over the corpus
    batches' segments x aligned segments, by segment -> back to their batch -> documents

The most frequent segments (POPULAR short ones at most, found by a histogram of the counts) are told
to every task instead, so the segments that nearly all batches hold are sent once a task, not once a
batch.

A and B tokens link where they end at the same byte. Then the bytes of one are the end of the
other's, so no more pairs of ids can link than twice all bytes of both vocabularies (some hundred
thousand): the table of pairs is bounded by the vocabularies, not the corpus, and every task has it.

Defined cases: a null or empty text, and one whose tokens of A or B don't spell it (white space
that B rewrites), has no tokens: zeros and an empty string of groups; special tokens' strings are
plain text; a text without a cut is one segment, whole; repeated rows and null ids give a row each;
an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import materialize
from .common import map_batches

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"  # how B writes a space
#: White space, and what versions of Unicode have held for it; a cut has none of these before it.
GAP = r"\s᠎​﻿"
#: Characters of text in a batch, about; one document is never divided.
BATCH = 16 << 20
#: Segments of a batch's list in a row.
PART = 1 << 14
#: Segments that every task is told at most, characters of one at most, and steps in a doubling of the histogram that finds them.
POPULAR, SHORT, STEPS = 1 << 17, 64, 16

SEGMENTED = "batch long, doc_ids array<bigint>, sizes array<int>, numbers binary, first int, segments array<string>, repeats array<int>"
ALIGNED = "segment string, n long, good boolean, n_a int, n_b int, links array<bigint>, groups string"
SCORED = "segment string, body string"
COMPOSED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself where it can be seen, else the next from U+0100 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in seen} | {chr(0x100 + n): b for n, b in enumerate(sorted(set(range(256)) - set(seen)))}


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_file: str, b_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a, self.b = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (self.a.get_vocab_size(with_added_tokens=True))
        for token, i in vocabulary.items():
            if all(c in alphabet for c in token):
                self.a_bytes[i] = bytes(alphabet[c] for c in token)
        ids = range(self.b.get_piece_size())
        self.pieces = [self.b.id_to_piece(i) for i in ids]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in zip(ids, self.pieces, strict=True)]
        self.a_size, self.b_size = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        with open(a_file, "rb") as file:
            kind = json.load(file)
        self.whole = kind["normalizer"] is not None or kind["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.cuts = self._cuts()
        start = rf"(?![{re.escape(self.cuts)}])" if self.cuts else ""
        self.pattern = re.compile(rf"[{GAP}]*[^{GAP}]+(?:{start}[{GAP}]+[^{GAP}]+)*(?:[{GAP}]++\Z)?")

    def most_links(self) -> int:
        """Pairs of ids that can link at most: the shorter token is one of the ends of the longer, and two tokens may be spelt alike."""
        return 2 * int(self.a_size.sum() + self.b_size.sum())

    def _cuts(self) -> str:
        """The white space before which a text may be cut, where something else stands before it.

        A's pattern never puts white space behind anything else in one piece, and its merges stay within a piece. No piece
        of B may hold the character behind anything else. B is given a segment with a space before it: if the segment doesn't
        begin with one itself, that space must be a token of its own, so no piece may hold the two together.
        """
        found = ""
        for c in " \n\t\r\f\v":
            shown = SPACE if c == " " else c
            spelt = [p for i, p in enumerate(self.pieces) if shown in p[1:] and not self.b.is_byte(i)]
            in_b = any(re.search(rf"[^{GAP}{SPACE}]{shown}", p) or c != " " and SPACE + shown in p for p in spelt)
            if not (self.whole or in_b):
                found += c
        return found

    def segments(self, text: str) -> list[str]:
        """A space and the text, cut."""
        spaced = " " + text
        found = self.pattern.findall(spaced) if self.cuts else []
        return found if sum(map(len, found)) == len(spaced) else [spaced]

    def tokenized(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both; B is given a segment without the space that it puts before it."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode([s.removeprefix(" ") for s in segments], num_threads=1)
        return a, [ids if s[0] == " " else ids[1:] for s, ids in zip(segments, b, strict=True)]


@lru_cache(1)
def pair(a_file: str, b_file: str) -> Pair:
    return Pair(a_file, b_file)


def packed(numbers: np.ndarray) -> bytes:
    """int32 values, byte by byte in four planes, compressed: they are written once and sent once."""
    return zstandard.ZstdCompressor(3).compress(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def segmented(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, batch_chars: int = BATCH) -> DataFrame:
    """Batches of documents: one row of ids, segments a document and their numbers, then the batch's distinct segments and how often each is there,
    PART a row, the first of them numbered `first`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, batch = pair(a_file, b_file), TaskContext.get().partitionId() << 32
        kind = pa.schema([("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("numbers", pa.binary()), ("first", pa.int32()), ("segments", pa.list_(pa.string())), ("repeats", pa.list_(pa.int32()))])
        ids, sizes, numbers, place, chars = [], [], [], {}, 0

        def finish() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
            yield pa.RecordBatch.from_pylist([{"batch": batch, "doc_ids": ids, "sizes": sizes, "numbers": packed(flat), "first": 0, "segments": [], "repeats": []}], kind)
            own, repeats = list(place), np.bincount(flat, minlength=len(place))
            for i in range(0, len(own), PART):
                row = {"batch": batch, "doc_ids": [], "sizes": [], "numbers": b"", "first": i, "segments": own[i : i + PART], "repeats": repeats[i : i + PART]}
                yield pa.RecordBatch.from_pylist([row], kind)

        for rows in batches:
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                found = both.segments(text) if text else []
                ids.append(doc_id)
                sizes.append(len(found))
                if found:
                    numbers.append(np.fromiter((place.setdefault(s, len(place)) for s in found), np.int32, len(found)))
                chars += len(text or "")
                if chars >= batch_chars:
                    yield from finish()
                    batch, ids, sizes, numbers, place, chars = batch + 1, [], [], [], {}, 0
        if ids:
            yield from finish()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SEGMENTED)


def aligned(counted: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Distinct segments (segment, n) with their tokens cut into groups where both end, and the last A and B id of each group."""

    def make():
        both = pair(a_file, b_file)

        def work(batch: pa.RecordBatch) -> list:
            segments = batch.column(0).to_pylist()
            a, b = both.tokenized(segments)
            good = [b"".join([both.a_bytes[i] for i in x]) == text.encode() == b"".join([both.b_bytes[i] for i in y]) for text, x, y in zip(segments, a, b, strict=True)]
            if not all(good):
                a, b = ([x if fits else [] for x, fits in zip(side, good, strict=True)] for side in (a, b))
            n_a, n_b = (np.fromiter(map(len, side), np.int32, len(side)) for side in (a, b))
            flat_a, flat_b = (np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((a, n_a), (b, n_b)))
            # What is spelt has as many bytes in A as in B, so ends may be counted on through the whole batch.
            ends_a, ends_b = np.cumsum(both.a_size[flat_a]), np.cumsum(both.b_size[flat_b])
            _, i, j = np.intersect1d(ends_a, ends_b, True, return_indices=True)
            links = flat_a[i] << 32 | flat_b[j]
            n_links = np.diff(np.searchsorted(i, np.cumsum(n_a)), prepend=0)
            said_a, said_b = (np.split(np.array(list(map(str, flat.tolist())), object), at[:-1] + 1) for flat, at in ((flat_a, i), (flat_b, j)))
            said = [",".join(x) + "|" + ",".join(y) for x, y in zip(said_a, said_b, strict=True)] if len(i) else []
            ends = np.cumsum(n_links).tolist()
            groups = [";".join(said[p:q]) for p, q in zip([0, *ends], ends, strict=False)]
            return [batch.column(0), batch.column(1), good, n_a, n_b, pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(links, pa.int64())), groups]

        return work

    return map_batches(counted.select("segment", "n"), make, ALIGNED)


def pair_counts(segments: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked id pairs (A id in the upper half) in order, how often the corpus links each, and whether its B id is linked no pair more often."""
    counts = segments.select("n", F.explode("links").alias("link")).groupBy("link").agg(F.sum("n").alias("n")).toArrow()
    if counts.num_rows > most:
        raise ValueError(f"{counts.num_rows} linked pairs, but the vocabularies allow {most}")
    link, n = counts.column("link").to_numpy(), counts.column("n").to_numpy()
    order = np.argsort(link)
    link, n = link[order], n[order]
    b_id = link & 0xFFFFFFFF
    highest = np.zeros(int(b_id.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, b_id, n)
    return link, n, n == highest[b_id]


def scored(segments: DataFrame, counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Aligned segments (segment, body): best links, their sum of counts and the groups in one string; an empty one where the tokens don't fit."""
    table = segments.sparkSession.sparkContext.broadcast(counts)

    def make():
        link, n, best = table.value

        def work(batch: pa.RecordBatch) -> list:
            column = batch.column("links")
            size = column.value_lengths().to_numpy()
            at = np.searchsorted(link, column.flatten().to_numpy())
            totals = [np.concatenate([[0], np.cumsum(values)]) for values in (n[at], best[at])]
            end = np.cumsum(size)
            count_sum, n_best = ((t[end] - t[end - size]).tolist() for t in totals)
            said = zip(batch.column("good").to_pylist(), n_best, count_sum, batch.column("groups").to_pylist(), strict=True)
            return [batch.column("segment"), [f"{x} {y} {groups}" if good else "" for good, x, y, groups in said]]

        return work

    return map_batches(segments.select("segment", "good", "links", "groups"), make, SCORED)


def popular(segments: DataFrame, most: int) -> DataFrame:
    """Those aligned segments that come most often: all of the upper steps of a histogram of counts that hold `most` together."""
    step = F.floor(F.log2(F.col("n").cast("double")) * STEPS).cast("int")
    short = segments.where(F.length("segment") <= SHORT).withColumn("step", step)
    held, least = 0, None
    for step, n in sorted(map(tuple, short.groupBy("step").count().collect()), reverse=True):  # 64 doublings at most
        held += n
        if held > most:
            break
        least = step
    return short.where(F.col("step") >= least).drop("step") if least is not None else segments.limit(0)


def composed(batches: DataFrame, parts: DataFrame, told: pa.Table) -> DataFrame:
    """The documents of batches from the bodies of their segments: those in parts (holder: the batch, number, body) and those told to all tasks."""
    table = batches.sparkSession.sparkContext.broadcast((told.column("segment").to_pylist(), told.column("body").to_pylist()))

    def make():
        index = {s: i for i, s in enumerate(table.value[0])}

        def work(batch: pa.RecordBatch) -> list:
            rows = zip(batch.column("first").to_pylist(), batch.column("segments").to_pylist(), strict=True)
            known = [[(k, index[s]) for k, s in enumerate(own, first) if s in index] for first, own in rows]
            return [*(batch.column(c) for c in ("batch", "doc_ids", "sizes", "numbers")), [packed(np.array(pairs, np.int32).ravel()) for pairs in known]]

        return work

    def compose(docs: pa.Table, segments: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({c: pa.array([], pa.string() if c == "groups" else pa.int64()) for c in names})
        row = next(r for r in docs.to_pylist() if r["doc_ids"])  # the others hold the batch's list
        numbers, known = unpacked(row["numbers"]), np.concatenate([unpacked(x).reshape(-1, 2) for x in docs.column("known").to_pylist()])
        body = [""] * (segments.num_rows + len(known))
        for k, i in known.tolist():
            body[k] = table.value[1][i]
        for k, said in zip(segments.column("number").to_pylist(), segments.column("body").to_pylist(), strict=True):
            body[k] = said
        split = [said.split(" ") if said else ("0", "0", "") for said in body]
        groups = [g for _, _, g in split]
        sums = {"n_best": [int(x) for x, _, _ in split], "count_sum": [int(x) for _, x, _ in split], "n_links": [g.count("|") for g in groups]}
        sums["n_a"] = [sum(1 + x.partition("|")[0].count(",") for x in g.split(";")) if g else 0 for g in groups]
        sums["n_b"] = [g.count(",") + 2 * g.count("|") - a for g, a in zip(groups, sums["n_a"], strict=True)]
        sums = {c: np.array(values, np.int64) for c, values in sums.items()}
        bad = np.array([not said for said in body], bool)
        found, start = {c: [] for c in names}, 0
        for doc_id, size in zip(row["doc_ids"], row["sizes"], strict=True):
            own, start = numbers[start : start + size], start + size
            if bad[own].any():
                own = own[:0]
            found["doc_id"].append(doc_id)
            for c, values in sums.items():
                found[c].append(int(values[own].sum()))
            found["n_groups"].append(found["n_links"][-1])  # a group ends with one A and one B token: its link
            found["groups"].append(";".join([groups[i] for i in own.tolist()]))
        return pa.table({c: pa.array(found[c], pa.string() if c == "groups" else pa.int64()) for c in names})

    names = [part.split()[0] for part in COMPOSED.split(", ")]
    own = map_batches(batches.select("batch", "doc_ids", "sizes", "numbers", "first", "segments"), make, "batch long, doc_ids array<bigint>, sizes array<int>, numbers binary, known binary")
    return own.groupBy("batch").cogroup(parts.groupBy("holder")).applyInArrow(compose, COMPOSED)


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, batch_chars: int = BATCH, most_popular: int = POPULAR) -> DataFrame:
    """doc_id, counts of tokens, groups and links, and the groups as `a1,a2|b1;a3|b2,b3` for every document."""
    batches = materialize(segmented(docs, a_file, b_file, batch_chars), "alignment-batches", compression="zstd")
    listed = batches.select(F.col("batch").alias("holder"), "first", F.posexplode(F.arrays_zip("segments", "repeats")).alias("place", "part"))
    listed = listed.select("holder", (F.col("first") + F.col("place")).alias("number"), F.col("part.segments").alias("segment"), F.col("part.repeats").cast("long").alias("n"))
    segments = materialize(aligned(listed.groupBy("segment").agg(F.sum("n").alias("n")), a_file, b_file), "alignment-segments", compression="zstd")
    counts = pair_counts(segments, pair(a_file, b_file).most_links())
    often = popular(segments, most_popular)
    told = scored(often, counts).toArrow()
    rest = listed.select("holder", "number", "segment").join(F.broadcast(often.select("segment")), "segment", "left_anti")
    return composed(batches, rest.join(scored(segments, counts), "segment").select("holder", "number", "body"), told)


def digests(docs: DataFrame) -> DataFrame:
    """align() with the groups' SHA-256 in their place; none for documents without tokens."""
    found = align(docs)
    return found.select(*found.columns[:-1], F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
