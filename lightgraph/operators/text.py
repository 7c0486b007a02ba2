"""Chunking of texts: by words, by sentences, by tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import content_id, words

CHUNK = "document_id string, chunk_id int, text string, start_char int, end_char int, token_count int"


def _checked(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be 0 or more and less than the chunk size")


def chunk_words(docs: DataFrame, size: int = 512, overlap: int = 50, least: int = 50) -> DataFrame:
    """Windows of `size` words, each starting `overlap` before the last one's end; those with fewer than `least` words
    are dropped, but keep their number. start_char counts the chunks' texts one after the other.

    docs: (document_id, text).
    """
    _checked(size, overlap)
    stride = size - overlap
    own = docs.select("document_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / stride)).cast("int")
    chunk = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i * stride + 1, F.lit(size)))
    # the words end here: only the chunks' own texts go on, a row each
    cut = own.select("document_id", "row", F.posexplode(F.transform(chunk, lambda c: F.struct(F.array_join(c, " ").alias("text"), F.size(c).alias("token_count")))).alias("chunk_id", "c"))
    made = cut.select("document_id", "row", "chunk_id", "c.text", "c.token_count")
    # by row, as two documents may have one id
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("row").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = made.withColumn("start_char", F.coalesce(before, F.lit(0)).cast("int")).where(F.col("token_count") >= least)
    return placed.select("document_id", "chunk_id", "text", "start_char", (F.col("start_char") + F.length("text")).cast("int").alias("end_char"), "token_count")


SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def packed_sentences(text: str, most: int) -> list[str]:
    """Sentences put together while their words are `most` at most; a longer sentence stands alone."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for sentence in filter(None, (s.strip() for s in SENTENCE_END.split(text))):
        n = len(sentence.split())
        if held and size + n > most:
            out.append(" ".join(held))
            held, size = [], 0
        held.append(sentence)
        size += n
    return [*out, " ".join(held)] if held else out


def _placed(docs: DataFrame, make_cut: Callable[[], Callable[[str], list[str]]]) -> DataFrame:
    """The chunks that a cut (made once a task) gives of each text, numbered and placed one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = None
        for batch in batches:
            cut = cut or make_cut()
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                for n, chunk in enumerate(cut(text or "")):
                    rows.append((key, n, chunk, at, at + len(chunk), len(chunk.split())))
                    at += len(chunk) + 1
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in CHUNK.split(", ")])

    return docs.select(F.col("document_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, CHUNK)


def chunk_sentences(docs: DataFrame, most: int = 512) -> DataFrame:
    """Chunks of whole sentences, `most` words at most."""
    return _placed(docs, lambda: lambda text: packed_sentences(text, most))


def chunk_tokens(docs: DataFrame, make_tokenizer, size: int = 512, overlap: int = 50, least: int = 50) -> DataFrame:
    """Windows of tokens. make_tokenizer() gives (encode, decode) and runs once a task, on the executors."""
    _checked(size, overlap)

    def make_cut() -> Callable[[str], list[str]]:
        encode, decode = make_tokenizer()

        def cut(text: str) -> list[str]:
            ids = encode(text) if text.strip() else []
            starts = [0, *range(size - overlap, max(1, len(ids) - overlap), size - overlap)] if ids else []
            return [decode(ids[s : s + size]) for s in starts]

        return cut

    return _placed(docs, make_cut).where(F.col("token_count") >= least)


def with_ids(texts: DataFrame) -> DataFrame:
    """(document_id, text): ids from the content, 12 hex digits."""
    return texts.select(content_id(F.col("text")).alias("document_id"), "text")
