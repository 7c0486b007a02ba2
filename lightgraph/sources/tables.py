"""The primary form of a graph: Parquet tables nodes, edges, rooms and pvs below a path. Also CSV and JSON forms."""

from __future__ import annotations

from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rooms
from ..operators.graph import Graph


def write_graph(graph: Graph, path: str, pvs: DataFrame | None = None) -> None:
    """All properties and the visibility. Edges are sorted by src within files, so that reads by src skip row groups."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.repartitionByRange("src").sortWithinPartitions("src", "pos").write.mode("overwrite").parquet(f"{path}/edges")
    rooms.summary(graph).write.mode("overwrite").parquet(f"{path}/rooms")
    if pvs is not None:
        pvs.write.mode("overwrite").parquet(f"{path}/pvs")


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def read_pvs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/pvs")


def six_decimals(vectors: pa.Array) -> pa.Array:
    """Values with six decimals between commas, nulls left out, rounded as C's printf rounds them: from the exact binary value, ties to even.
    The JVM's formatter rounds the shortest decimal half up: -0.0703125 would be -0.070313."""
    texts = (None if v is None else ",".join(["%.6f" % x for x in v if x is not None]) for v in vectors.to_pylist())
    return pa.array(texts, pa.string())


def csv_lines(embeddings: DataFrame) -> DataFrame:
    """(node_id, line): values with six decimals between commas."""
    return embeddings.select("node_id", F.arrow_udf(six_decimals, "string")(F.col("embedding").cast("array<double>")).alias("line"))


def write_csv(embeddings: DataFrame, path: str) -> None:
    csv_lines(embeddings).orderBy("node_id").select("line").write.mode("overwrite").text(path)


def vocab_json(vocab: DataFrame) -> DataFrame:
    """One row (json): {entity: id}, as the compatible form holds it; the table itself is the scalable one."""
    return vocab.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity", "entity_id"))))).alias("json"))


def read_vocab_json(spark: SparkSession, path: str) -> DataFrame:
    """(entity, entity_id)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,long>")).alias("entity", "entity_id"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines."""
    chunks.write.mode("overwrite").json(path)


CHUNKS = "text string, chunk_id int, document_id string, start_char int, end_char int, metadata map<string,string>"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from files of JSON lines, of JSON arrays, or of both kinds.

    A line of JSON lines is an object and never begins with a bracket, so a file with a line that does holds an array. Such a
    file is read by one task, as its form asks for; lines are split like any text.
    """
    bracket = F.max(F.ltrim("value").startswith("["))
    files = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(bracket.alias("array")).collect()  # a row a file
    arrays, others = ([unquote(r.file) for r in files if r.array == kind] for kind in (True, False))
    if not arrays:
        return spark.read.schema(CHUNKS).json(path)
    found = spark.read.schema(CHUNKS).option("multiLine", True).json(arrays)
    return found.unionByName(spark.read.schema(CHUNKS).json(others)) if others else found
