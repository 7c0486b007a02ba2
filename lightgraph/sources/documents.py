"""Documents from files: text, Markdown, reStructuredText and HTML. PDF needs a library that isn't there and is left out."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import content_id
from ..operators.text import chunk_words

EXTENSIONS = ("txt", "md", "markdown", "rst", "html")


def decoded(data: bytes) -> str:
    """UTF-8, or Latin-1, which takes any bytes."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


class _Reader(HTMLParser):
    """What a page says outside scripts and styles; markup parts words, entities of all kinds are characters."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.said: list[str] = []
        self.unseen: str | None = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.unseen is None and tag in ("script", "style"):
            self.unseen = tag
        elif self.unseen is None:
            self.said.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == self.unseen:
            self.unseen = None
        elif self.unseen is None:
            self.said.append(" ")

    def handle_startendtag(self, tag: str, attrs) -> None:
        if self.unseen is None:
            self.said.append(" ")

    def handle_data(self, data: str) -> None:
        if self.unseen is None:
            self.said.append(data)

    def handle_comment(self, data: str) -> None:
        self.said.append(" ")


def text_of_html(page: str) -> str:
    """Scripts, styles and tags out, all entities decoded, white space collapsed."""
    reader = _Reader()
    reader.feed(page)
    reader.close()
    return " ".join("".join(reader.said).split())


def html_texts(pages: DataFrame, key: str, column: str) -> DataFrame:
    """(key, text) of pages, with the full table of entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if p is None else text_of_html(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return pages.select(key, column).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, text string")


def load_directory(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(document_id, content, source_path, metadata) of the files with known extensions. Files that can't be read are left
    out; Spark logs a warning for each."""
    glob = "*.{" + ",".join(EXTENSIONS) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for where, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                text = decoded(data)
                out.append(text_of_html(text) if where.lower().endswith(".html") else text)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(out, pa.string())], names=["path", "length", "content"])

    read = files.select("path", "length", "content").mapInArrow(run, "path string, length long, content string")
    name = F.element_at(F.split("path", "/"), -1)
    meta = F.create_map(F.lit("filename"), name, F.lit("extension"), F.concat(F.lit("."), F.lower(F.element_at(F.split(name, r"\."), -1))), F.lit("size"), F.col("length").cast("string"))
    return read.select(content_id(F.col("content")).alias("document_id"), "content", F.col("path").alias("source_path"), meta.alias("metadata"))


def load_and_chunk(spark: SparkSession, path: str, size: int = 512, overlap: int = 50, recursive: bool = True, least: int = 50) -> DataFrame:
    return chunk_words(load_directory(spark, path, recursive).select("document_id", F.col("content").alias("text")), size, overlap, least)
