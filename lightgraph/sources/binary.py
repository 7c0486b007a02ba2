"""Binary files of embeddings (.emb) and graphs (level files). Tasks read ranges of rows; nothing reads a whole file.

Embeddings: [rows u32][dim u32][f32 ...], little-endian, by rows; optionally a magic word and a version before.
Level files: a header of 64 bytes, nodes of 16 bytes, edges by node (row_ptr, col_idx, edges of 8 bytes), the rooms of the
nodes, the table of rooms. They keep no properties, no directional luminance and no visibility; the Parquet form keeps all.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import l2_normalize
from ..operators import rooms as room_operators
from ..operators.graph import MOST_EDGES, MOST_NODES, Graph, complete_nodes
from ..params import BINS, GraphError

# Header words and sizes of the formats, little-endian.
MAGIC, VERSION = 0x42444752, 1
HEADER, NODE, EDGE, ROOM = 64, 16, 8, 12
MOST_ROOMS, MOST_BYTES = 10**7, 10 * 1024**3
HEADER_FORMAT = "<IIIIIB3xQQQQI4x"

#: Rows that one task reads.
ROWS = 65_536


def _open(path: str):
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store, at


def _bytes(path: str, start: int, n: int) -> bytes:
    store, at = _open(path)
    with store.open_input_file(at) as f:
        data = f.read_at(n, start)
    if len(data) < n:
        raise GraphError(f"{path} ends early")
    return data


def emb_info(path: str, check_header: bool = False) -> dict:
    """rows, dim, bytes and where the values start, from the header alone."""
    start = 0
    if check_header:
        magic, version = struct.unpack("<II", _bytes(path, 0, 8))
        if magic != MAGIC or version != VERSION:
            raise GraphError(f"{path} has no such header")
        start = 8
    rows, dim = struct.unpack("<II", _bytes(path, start, 8))
    store, at = _open(path)
    size = store.get_file_info(at).size
    if rows == 0 or dim == 0:
        raise GraphError(f"{path} is empty")
    if size < start + 8 + 4 * rows * dim:
        raise GraphError(f"{path} has {size} bytes, too few for {rows} x {dim}")
    return {"num_nodes": rows, "dim": dim, "bytes": size, "start": start + 8}


def _ranges(spark: SparkSession, rows: int, run, schema: str) -> DataFrame:
    parts = -(-rows // ROWS)
    return spark.range(0, parts, 1, max(1, min(parts, 10_000))).mapInArrow(run, schema)


def read_emb(spark: SparkSession, path: str, check_header: bool = False) -> DataFrame:
    """(node_id, embedding array<float>)."""
    info = emb_info(path, check_header)
    rows, dim, start = info["num_nodes"], info["dim"], info["start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                a, b = part * ROWS, min(rows, (part + 1) * ROWS)
                v = np.frombuffer(_bytes(path, start + 4 * dim * a, 4 * dim * (b - a)), "<f4")
                lists = pa.ListArray.from_arrays(np.arange(0, len(v) + 1, dim, dtype=np.int32), pa.array(v))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), lists], names=["node_id", "embedding"])

    return _ranges(spark, rows, run, "node_id long, embedding array<float>")


def write_emb(embeddings: DataFrame, path: str, normalize: bool = True, header: bool = False) -> None:
    """One file of all rows by node_id, streamed through the driver: the compatible form. Large tables stay Parquet."""
    first = embeddings.select(F.size("embedding").alias("n")).limit(1).collect()
    rows = embeddings.count()
    if not rows or not first[0].n:
        raise GraphError("there are no embeddings")
    vector = l2_normalize(F.col("embedding")) if normalize else F.col("embedding")
    store, at = _open(path)
    with store.open_output_stream(at) as out:
        out.write((struct.pack("<II", MAGIC, VERSION) if header else b"") + struct.pack("<II", rows, first[0].n))
        for r in embeddings.select("node_id", vector.alias("embedding")).orderBy("node_id").select("embedding").toLocalIterator():
            if len(r.embedding) != first[0].n:
                raise GraphError("vectors differ in length")
            out.write(np.asarray(r.embedding, "<f4").tobytes())


def level_header(path: str) -> dict:
    """Counts and section places of a level file, checked against the limits."""
    names = ("magic", "version", "num_nodes", "num_edges", "num_rooms", "bins", "nodes_at", "edges_at", "rooms_at", "pvs_at", "checksum")
    h = dict(zip(names, struct.unpack(HEADER_FORMAT, _bytes(path, 0, HEADER)), strict=True))
    store, at = _open(path)
    size = store.get_file_info(at).size
    for wrong, what in (
        (h["magic"] != MAGIC, "magic word"), (h["version"] != VERSION, "version"), (h["num_nodes"] > MOST_NODES, "nodes"), (h["num_edges"] > MOST_EDGES, "edges"),
        (h["num_rooms"] > MOST_ROOMS, "rooms"), (h["bins"] == 0, "bins"), (size > MOST_BYTES, "size"),
    ):
        if wrong:
            raise GraphError(f"{path}: {what} not as they should be")
    return h


def write_level(graph: Graph, path: str) -> None:
    """A level file of a graph whose ids are 0 .. n-1, streamed through the driver, with room for every section."""
    n, e = graph.counts().collect()[0]
    lo, hi = graph.nodes.agg(F.min("node_id"), F.max("node_id")).collect()[0]
    if (lo, hi) != (0, n - 1):
        raise GraphError("a level file needs ids from 0 without gaps")
    rooms = room_operators.summary(graph).orderBy("room").collect()
    edges_at = HEADER + NODE * n
    rooms_at = edges_at + 4 * (n + 1) + 4 * e + EDGE * e + 4 + 4 * n
    ordered = graph.edges.orderBy("src", "pos")
    store, at = _open(path)
    with store.open_output_stream(at) as out:
        out.write(struct.pack(HEADER_FORMAT, MAGIC, VERSION, n, e, len(rooms), BINS, HEADER, edges_at, rooms_at, rooms_at + 4 + ROOM * len(rooms), 0))
        for r in graph.nodes.select("luminance", "reflection", "refraction", "default_bin", "node_id").orderBy("node_id").toLocalIterator():
            out.write(struct.pack("<fffB3x", r.luminance, r.reflection, r.refraction, r.default_bin))
        out.write(struct.pack("<I", 0))
        for r in graph.csr().orderBy("node_id").toLocalIterator():
            out.write(struct.pack("<I", r.row_ptr + r.degree))
        for r in ordered.select("dst").toLocalIterator():
            out.write(struct.pack("<I", r.dst))
        for r in ordered.select("attenuation", "bin", "is_portal").toLocalIterator():
            out.write(struct.pack("<fBB2x", r.attenuation, r.bin, r.is_portal))
        out.write(struct.pack("<I", n))
        for r in graph.nodes.select("node_id", "room").orderBy("node_id").toLocalIterator():
            out.write(struct.pack("<I", r.room))
        out.write(struct.pack("<I", len(rooms)))
        for r in rooms:
            out.write(struct.pack("<III", r.room, r.node_start, r.node_count))


def read_level(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """The graph and its rooms (room, node_start, node_count)."""
    h = level_header(path)
    n, e = h["num_nodes"], h["num_edges"]
    rooms_of = h["edges_at"] + 4 * (n + 1) + 4 * e + EDGE * e + 4
    node_type = np.dtype([("luminance", "<f4"), ("reflection", "<f4"), ("refraction", "<f4"), ("bin", "u1"), ("pad", "V3")])
    edge_type = np.dtype([("attenuation", "<f4"), ("bin", "u1"), ("portal", "u1"), ("pad", "V2")])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                a, b = part * ROWS, min(n, (part + 1) * ROWS)
                v = np.frombuffer(_bytes(path, h["nodes_at"] + NODE * a, NODE * (b - a)), node_type)
                room = np.frombuffer(_bytes(path, rooms_of + 4 * a, 4 * (b - a)), "<u4")
                columns = [np.arange(a, b), v["luminance"].astype(float), v["reflection"].astype(float), v["refraction"].astype(float), v["bin"].astype(np.int32), room.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node_id", "luminance", "reflection", "refraction", "default_bin", "room"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                a, b = part * ROWS, min(n, (part + 1) * ROWS)
                ptr = np.frombuffer(_bytes(path, h["edges_at"] + 4 * a, 4 * (b - a + 1)), "<u4").astype(np.int64)
                s, t = int(ptr[0]), int(ptr[-1])
                if (np.diff(ptr) < 0).any() or t > e:
                    raise GraphError(f"{path}: edge offsets go down or past the end")
                col = np.frombuffer(_bytes(path, h["edges_at"] + 4 * (n + 1) + 4 * s, 4 * (t - s)), "<u4")
                v = np.frombuffer(_bytes(path, h["edges_at"] + 4 * (n + 1) + 4 * e + EDGE * s, EDGE * (t - s)), edge_type)
                degree = np.diff(ptr)
                pos = np.arange(s, t) - np.repeat(ptr[:-1], degree)
                columns = [np.repeat(np.arange(a, b), degree), col.astype(np.int64), pos.astype(np.int32), v["attenuation"].astype(float), v["bin"].astype(np.int32), v["portal"] != 0]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["src", "dst", "pos", "attenuation", "bin", "is_portal"])

    node_rows = _ranges(spark, n, nodes, "node_id long, luminance double, reflection double, refraction double, default_bin int, room int")
    edge_rows = _ranges(spark, n, edges, "src long, dst long, pos int, attenuation double, bin int, is_portal boolean")
    graph = Graph(complete_nodes(node_rows.withColumn("dir_lum", F.array_repeat("luminance", BINS))), edge_rows)
    return graph, level_rooms(spark, path, h)


def level_rooms(spark: SparkSession, path: str, h: dict) -> DataFrame:
    """(room, node_start, node_count) as the file's room table has them."""
    at = h["rooms_at"]
    count = struct.unpack("<I", _bytes(path, at, 4))[0] if h["num_rooms"] else 0
    if count != h["num_rooms"]:
        raise GraphError(f"{path}: {count} rooms in the table, {h['num_rooms']} in the header")

    def rooms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                a, b = part * ROWS, min(count, (part + 1) * ROWS)
                v = np.frombuffer(_bytes(path, at + 4 + ROOM * a, ROOM * (b - a)), "<u4").reshape(-1, 3).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(v[:, 0].astype(np.int32)), pa.array(v[:, 1]), pa.array(v[:, 2])], names=["room", "node_start", "node_count"])

    return _ranges(spark, count, rooms, "room int, node_start long, node_count long")
