"""WARC archives, index first.

Each task writes its records, every one a gzip member, to an archive of its own in the shared
folder, and returns a row of the index for each: archive, offset, length, URL and digest. The
index is a table; readers select from it, deal its rows out by archive and stretch, sort them by
offset, join neighbouring ranges and read the archives in those ranges only.

Records whose payloads are equal and not tiny are written once: the one with the smallest page_id
is a response, the others revisit it.

An archive's name holds its task's attempt, and the index names it, so a task that runs again
writes another file and never changes one that the index knows.

Defined cases: a null html is an empty payload; a null url gives a record without a target; a null
page_id is written as `null` and never the one revisited; rows repeated with the smallest page_id
are responses all; an empty table gives an empty index; only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_path

#: Smaller payloads are always written.
LEAST_BYTES = 100
#: Bytes of an archive after which its task begins another, of a gap that a read goes over, and of one read.
ARCHIVE, GAP, READ = 1 << 30, 64 << 10, 8 << 20
#: Bytes of an archive that one reader takes.
STRETCH = 8 << 20
#: More records than this with one payload are told of it by a table that every task has, so that no key gathers them: a row for
#: so many records at least.
COMMON = 10_000
#: Records have no fetch time of their own.
DATE = "1970-01-01T00:00:00Z"
LEVEL = 4

INDEX = "page_id long, archive string, offset long, length long, url string, digest string, record_type string, refers_to long"


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit without; both tell the payload's size in the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is None:
        http += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}", "", ""]
    return "\r\n".join(head).encode() + http + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """page_id, url, payload (None for a revisit), payload_bytes, digest, record_type, refers_to of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
    revisit = fields["WARC-Type"] == "revisit"
    number = lambda x: None if x == "<urn:page:null>" else int(x[len("<urn:page:") : -1])
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": None if revisit else payload, "payload_bytes": size,
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
        "record_type": fields["WARC-Type"], "refers_to": number(fields["WARC-Refers-To"]) if revisit else None,
    }


def write(pages: DataFrame) -> DataFrame:
    """Write the archives and return their index, a written table."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    digest = F.sha2("payload", 256)
    found = rows.where(F.octet_length("payload") >= LEAST_BYTES).select("page_id", digest.alias("digest")).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = materialize(found.where("n > 1 and first is not null"), "warc-again")
    common = F.broadcast(again.where(F.col("n") > COMMON).select("digest", F.col("first").alias("first_")))
    told = rows.withColumn("digest", digest).join(common, "digest", "left")
    # their keys in the second join are their own, so they are spread there
    key = F.when(F.col("first_").isNull(), F.col("digest")).otherwise(F.concat(F.lit("common "), F.col("page_id").cast("string")))
    told = told.withColumn("key", key).join(again.where(F.col("n") <= COMMON).select(F.col("digest").alias("key"), "first"), "key", "left")
    told = told.withColumn("first", F.coalesce("first_", "first")).withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))
    folder = shared_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        task, number, stream, name = TaskContext.get(), 0, None, ""
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for page, url, data, sha, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if stream is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    stream, offset, number = store.open_output_stream(f"{at}/{name}", compression=None), 0, number + 1
                    info = b"software: lightgraph\r\nformat: WARC File Format 1.1\r\n"
                    offset += stream.write(gzipped(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:{name}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
                made = gzipped(record(page, url, data, sha, refers))
                stream.write(made)
                for to, v in zip(out, (page, name, offset, len(made), url, sha, "response" if refers is None else "revisit", refers), strict=True):
                    to.append(v)
                offset += len(made)
                if offset >= ARCHIVE:
                    stream.close()
                    stream = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
        if stream is not None:
            stream.close()

    names = [c.split()[0] for c in INDEX.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in INDEX.split(", ")]
    index = materialize(told.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, INDEX), "warc-index")
    return index.withColumn("archive", F.concat(F.lit(folder + "/"), "archive"))


def ranges(places: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) places as reads (start, end, places): gaps up to `gap` are read over, reads end near `most` bytes."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    for offset, length in places:
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            out[-1][2].append((offset, length))
            out[-1] = (out[-1][0], max(out[-1][1], offset + length), out[-1][2])
        else:
            out.append((offset, offset + length, [(offset, length)]))
    return out


def read(selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of rows of an index, from byte ranges of their archives; payload is null for revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, store, source = None, None, None
        for batch in batches:
            archives, places = batch.column("archive").to_pylist(), list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True))
            s = 0
            while s < len(places):
                e = s
                while e < len(places) and archives[e] == archives[s]:
                    e += 1
                if archives[s] != name:
                    if source is not None:
                        source.close()
                    name = archives[s]
                    store, at = fs.FileSystem.from_uri(name)
                    source = store.open_input_file(at)
                for start, end, some in ranges(places[s:e]):
                    data = memoryview(source.read_at(end - start, start))
                    got = [parsed(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in some]
                    yield pa.RecordBatch.from_arrays([pa.array([g[c] if c != "payload" or payloads else None for g in got], t) for c, t in columns], names=[c for c, _ in columns])
                s = e
        if source is not None:
            source.close()

    columns = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    # the number of readers follows the bytes to read, as the rows of the index are small
    size = selected.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).collect()[0].bytes
    dealt = selected.select("archive", "offset", "length").repartition(max(1, -(-size // STRETCH)), F.col("archive"), F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    back = read(write(pages), payloads=False)
    return back.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
