"""BPE encoding and decoding, with tree concatenation for long texts.

A text up to LEAF bytes is encoded at once. A longer one is cut into leaves at code points; the
leaves are rows of their own, encoded in parallel, then joined in a tree. At each join the last
tokens of the left side and the first of the right are encoded again as one string, in windows
that grow until both sides agree exactly. A window may end between two tokens where one of two
exact tests holds:

- The characters on both sides are of different classes (letter, number, white space, other) of
  the tokenizer's pattern, and none is an apostrophe or a blank that goes with what follows it:
  a piece of the pattern ends there in every text.
- They are of one class, so that they lie in one piece or none of the sides sees the difference,
  and the two tokens that meet there stay apart when they are merged as one string. A sequence
  whose neighbours all stay apart is the encoding of its string: merges never cross such a place.

One of them soon holds in any script, with or without spaces. Else the window grows; at worst,
as in a text of one repeated letter, it is both sides whole. Special tokens split a text first. Leaves are written with their numbers, so a
stage that runs again after a lost executor can't number them anew.

Defined cases: a null text is empty, with no tokens; repeated rows are encoded one by one; an
empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_batches

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = {"<|endoftext|>": 50256}
#: Bytes of text that one leaf holds.
LEAF = 32 << 10
#: Tokens of the first window on each side, and places that are tried at each end of it.
FIRST_WINDOW, NEAR = 16, 12


@lru_cache(1 << 16)
def _kind(c: str) -> str:
    """The class of the tokenizer's pattern that a character belongs to; none where versions of Unicode differ about it."""
    if c.isspace() and c not in "\x1c\x1d\x1e\x1f":  # Python counts these four as white space, the pattern doesn't
        return "S"
    now, before = (u.category(c)[0] for u in (unicodedata, unicodedata.ucd_3_2_0))
    if now != before:
        return ""
    return now if now in "LN" else "O"


class Codec:
    """A byte-level BPE from ranks; ids and their bytes."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(max(ranks.values()), *SPECIAL.values()) + 1)
        for token, i in [*ranks.items(), *((k.encode(), v) for k, v in SPECIAL.items())]:
            self.bytes[i] = token
        self.ranks, self.most = ranks, len(self.bytes)
        self.encoded = 0  # characters that joins have encoded again
        self._pairs: dict[tuple[int, int], bool] = {}

    def plain(self, text: str) -> list[int]:
        """Without special tokens, at once."""
        return self.model.encode_ordinary(text)

    def encode(self, text: str | None) -> list[int]:
        """At once, special tokens in the text included."""
        out: list[int] = []
        for i, part in enumerate(split_special(text or "")):
            out += [SPECIAL[part]] if i % 2 else self.plain(part)
        return out

    def decode(self, ids) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])

    def merged(self, piece: bytes) -> list[int]:
        """The tokens of a short piece: of all neighbours those of the lowest rank merge first, the leftmost of equal ones."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, self.most), n) for n, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == self.most:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def apart(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens stay as they are when their bytes are encoded as one piece."""
        key = (a, b)
        if key not in self._pairs:
            if len(self._pairs) > 200_000:
                self._pairs.clear()
            self._pairs[key] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return self._pairs[key]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring texts as one, from the encodings of each."""
        if not left or not right:
            return left + right
        k = FIRST_WINDOW
        while True:
            a, b = self._end(left, len(left) - k, -1, False), self._end(right, k, 1, True)
            if a is not None and b is not None:
                (cut, test), (till, also) = a, b
                text = self.decode(left[cut:] + right[:till]).decode()
                self.encoded += len(text)
                ids = self.plain(text)
                if (not test or self.apart(left[cut - 1], ids[0])) and (not also or self.apart(ids[-1], right[till])):
                    return left[:cut] + ids + right[till:]
            k *= 2

    def _end(self, ids: list[int], at: int, step: int, right: bool) -> tuple[int, bool] | None:
        """A place at `at` or a little beyond where a window may end, and whether the tokens there must be shown to stay apart. The sequence's own
        end always serves."""
        for n in range(at, at + NEAR * step, step):
            if n <= 0 or n >= len(ids):
                return (0 if step < 0 else len(ids)), False
            if self.bytes[ids[n]][0] & 0xC0 == 0x80:
                continue  # inside a code point
            before, after = self._last(ids, n), self.decode(ids[n : n + 4]).decode("utf-8", "ignore")[:1]
            if len(before) < 3 or not after or "'" in before + after:
                continue  # contractions are pieces of their own
            x, y = _kind(before[-1]), _kind(after)
            if not x or not y:
                continue
            if x == y:
                return n, True
            if before[-1] != " " and not (right and x == "S"):  # white space before something else depends on what the window sees of it
                return n, False
        return None

    def _last(self, ids: list[int], n: int) -> str:
        """The last three characters before token n, fewer if the twelve tokens before it have no more."""
        return self.decode(ids[max(0, n - 12) : n]).decode("utf-8", "ignore")[-3:]


def split_special(text: str) -> list[str]:
    """Ordinary text at even places, special tokens at odd ones."""
    return re.split("(" + "|".join(map(re.escape, SPECIAL)) + ")", text)


def leaves(text: str, leaf: int = LEAF) -> list[str]:
    """The text in halves of halves, until each has at most `leaf` bytes."""
    if len(text) < 2 or len(text.encode()) <= leaf:
        return [text]
    half = len(text) // 2
    return leaves(text[:half], leaf) + leaves(text[half:], leaf)


def join_tree(codec: Codec, parts: list[list[int]]) -> list[int]:
    while len(parts) > 1:
        parts = [codec.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def encode_tree(codec: Codec, text: str, leaf: int = LEAF) -> list[int]:
    """Tree concatenation in one process; what encode() gives."""
    out: list[int] = []
    for i, part in enumerate(split_special(text)):
        out += [SPECIAL[part]] if i % 2 else join_tree(codec, [codec.plain(x) for x in leaves(part, leaf)])
    return out


@lru_cache(1)
def codec(path: str = VOCABULARY) -> Codec:
    """One codec a Python worker."""
    return Codec(path)


def pack(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def unpack(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def encode_rows(docs: DataFrame, make_row, row_schema: str, path: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """make_row(codec, doc_id, ids) -> a list of rows of row_schema, for the ids of every document. Texts over a leaf go by
    way of their leaves: rows that are dealt out, encoded wherever they land, and met again by their row's key."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    width = len(row_schema.split(","))

    def whole():
        own = codec(path)

        def run(batch):
            out = [r for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for r in make_row(own, i, own.encode(t))]
            return list(zip(*out, strict=True)) if out else [[] for _ in range(width)]

        return run

    def cut():
        at = TaskContext.get().partitionId() << 40
        count = iter(range(1 << 40))

        def run(batch):
            out: list[list] = [[] for _ in range(6)]
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                key, n = at + next(count), 0
                for part, s in enumerate(split_special(t)):
                    for x in [s] if part % 2 else leaves(s, leaf):
                        for to, v in zip(out, (key, i, n, part, x, None), strict=True):
                            to.append(v)
                        n += 1
            return out[:5]

        return run

    def ids():
        own = codec(path)

        def run(batch):
            made = [pack([SPECIAL[t]] if p % 2 else own.plain(t)) for p, t in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            return [batch.column("key"), batch.column("doc_id"), batch.column("n"), batch.column("part"), made]

        return run

    def merge(table: pa.Table) -> pa.Table:
        own = codec(path)
        parts: dict[int, list[list[int]]] = {}
        for n in np.argsort(table.column("n").to_numpy(), kind="stable").tolist():
            parts.setdefault(table.column("part")[n].as_py(), []).append(unpack(table.column("ids")[n].as_py()))
        joined = [i for _, x in sorted(parts.items()) for i in join_tree(own, x)]
        made = make_row(own, table.column("doc_id")[0].as_py(), joined)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)] if made else [pa.array([], f.type) for f in arrow], schema=arrow)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(row_schema))
    long = F.octet_length("text") > leaf
    short = map_batches(rows.where(~long), whole, row_schema)
    pieces = materialize(map_batches(rows.where(long), cut, "key long, doc_id long, n int, part int, text string"), "bpe-leaves")
    encoded = map_batches(pieces.repartition(F.xxhash64("key", "n")), ids, "key long, doc_id long, n int, part int, ids binary")
    return short.unionByName(encoded.groupBy("key").applyInArrow(merge, row_schema))


def round_trip(docs: DataFrame, path: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""

    def row(own, doc_id, ids):
        text = own.decode(ids).decode("utf-8", "replace").encode()
        return [(doc_id, len(ids), hashlib.sha256(pack(ids)).hexdigest(), hashlib.sha256(text).hexdigest())]

    return encode_rows(docs, row, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path, leaf)
