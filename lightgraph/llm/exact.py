"""Exact dedup: a tree merge of sorted digest runs.

Texts are equal when they are identical after lower-casing A-Z. Each task turns its rows into runs
of at most RUN rows: digests in the order of their leading bits, equal ones together, the first of
them an entry with the identifier that stays and the number of rows. Runs are then merged in
binomial rounds. A run starts in a slot; in round r the FAN slots that differ in digit r alone
exchange their runs, so that each keeps the digests with its own value in that digit. There the
FAN sorted runs are merged, equal digests become one entry again, and the better identifier stays.
After the last round every digest is in one slot and one entry. A text that makes up a third of all
rows is one entry of each run, FAN entries of a slot in each round, and one in the end.

Leading bits only order a run. Entries become one when the whole SHA-256 and the length agree, so
digests that collide in their leading bits stay apart, at every level.

The way back joins twice, never by a hot key: the entries of runs find their digest's last entry
(a digest is as often there as there are runs), the rows find the entry of their own run.

Defined cases: a null or empty text is the empty text; a null doc_id stays only if its whole group
has none, and keep_id is null then; of repeated rows with the id that stays, one stays; an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of a run at most; slots that exchange runs in a round (2 to the power of FAN_BITS).
RUN, FAN_BITS = 1 << 17, 4

ROWS = pa.schema([("run", pa.int64()), ("lead", pa.int64()), ("digest", pa.binary()), ("size", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])
ENTRIES = "slot long, lead long, digest binary, size long, keep_id long, run long, n long"


def ordered(lead: np.ndarray, digest: np.ndarray, size: np.ndarray, unknown: np.ndarray, ids: np.ndarray, run: np.ndarray, largest: bool) -> tuple[np.ndarray, np.ndarray]:
    """The order of entries by leading bits, digest, size and identifier (the best first), and where another text begins in it.

    The sort by leading bits is stable and finds the sorted runs that it is given, so it is a merge of them.
    """
    by = np.argsort(lead, kind="stable")
    same = np.flatnonzero(lead[by][1:] == lead[by][:-1])
    if len(same):  # few rows: texts that come again, and digests that agree in their leading bits
        places = np.union1d(same, same + 1)
        rows = by[places]
        # Rows with equal leading bits are neighbours, so sorting these places among themselves keeps every one in its stretch.
        by[places] = rows[np.lexsort((run[rows], ~ids[rows] if largest else ids[rows], unknown[rows], size[rows], digest[rows], lead[rows]))]
    fresh = np.ones(len(by), bool)
    fresh[1:] = (lead[by][1:] != lead[by][:-1]) | (digest[by][1:] != digest[by][:-1]) | (size[by][1:] != size[by][:-1])
    return by, fresh


def fixed(digests: list[bytes]) -> np.ndarray:
    """Digests of 32 bytes as an array that numpy sorts and compares byte by byte."""
    return np.frombuffer(b"".join(digests), "S32") if digests else np.empty(0, "S32")


def leading(digest: bytes, bits: int) -> int:
    """The leading bits, in the upper bits of an unsigned long; as a signed long they order alike after the first bit is turned."""
    return int.from_bytes(digest[:8], "big") >> (64 - bits) << (64 - bits) if bits else 0


def digested(docs: DataFrame, run_rows: int, lead_bits: int, largest: bool) -> DataFrame:
    """Rows (run, lead, digest, size, doc_id, n), sorted within a run; n is 0 but on the row that stays of the run's equal ones."""

    def finish(run: int, found: list[tuple]) -> pa.RecordBatch:
        digests, sizes, ids = zip(*found, strict=True)
        lead = np.array([leading(d, lead_bits) for d in digests], np.uint64)
        unknown, known = np.array([i is None for i in ids]), np.array([i or 0 for i in ids], np.int64)
        digest, size = fixed(list(digests)), np.array(sizes, np.int64)
        by, fresh = ordered(lead, digest, size, unknown, known, np.zeros(len(ids), np.int64), largest)
        first = np.flatnonzero(fresh)
        n = np.zeros(len(by), np.int64)
        n[first] = np.diff(np.append(first, len(by)))
        columns = [np.full(len(by), run), lead[by].view(np.int64), pa.array([digests[i] for i in by], pa.binary()), size[by], pa.array(known[by], mask=unknown[by]), n]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=ROWS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, found = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plain = (text or b"").lower()  # bytes: A-Z alone
                found.append((hashlib.sha256(plain).digest(), len(plain), doc_id))
                if len(found) == run_rows:
                    yield finish(run, found)
                    run, found = run + 1, []
        if found:
            yield finish(run, found)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(work, "run long, lead long, digest binary, size long, doc_id long, n long")


def merged(entries: DataFrame, rounds: int, largest: bool) -> DataFrame:
    """One entry for each digest: `rounds` exchanges among FAN slots, each followed by a merge of what a slot was sent."""

    def merge(table: pa.Table) -> pa.Table:
        unknown = table.column("keep_id").is_null().to_numpy()
        ids = table.column("keep_id").fill_null(0).to_numpy()
        digests = table.column("digest").to_pylist()
        by, fresh = ordered(table.column("lead").to_numpy().view(np.uint64), fixed(digests), table.column("size").to_numpy(), unknown, ids, table.column("run").to_numpy(), largest)
        first = np.flatnonzero(fresh)
        out = table.take(pa.array(by[first]))
        n = np.add.reduceat(table.column("n").to_numpy()[by], first)
        return out.set_column(out.schema.get_field_index("n"), "n", pa.array(n))

    for r in range(rounds):
        place = FAN_BITS * (rounds - 1 - r)
        own = F.shiftrightunsigned("lead", 64 - FAN_BITS * (r + 1)).bitwiseAND(F.lit((1 << FAN_BITS) - 1))
        partner = F.col("slot").bitwiseAND(F.lit(~(((1 << FAN_BITS) - 1) << place))).bitwiseOR(F.shiftleft(own, place))
        entries = entries.withColumn("slot", partner).groupBy("slot").applyInArrow(merge, ENTRIES)
    return entries


def classes(docs: DataFrame, largest: bool = True, run_rows: int = RUN, lead_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row. largest: the largest doc_id of a group stays, else the smallest."""
    rows = materialize(digested(docs, run_rows, lead_bits, largest), "exact-runs")
    runs = rows.where("n > 0")
    number = runs.select("run").distinct().count()
    bits = max(1, (max(1, number) - 1).bit_length())
    rounds = min(-(-bits // FAN_BITS), 64 // FAN_BITS - 1)
    slot = F.pmod(F.xxhash64("run"), F.lit(1 << (FAN_BITS * rounds)))
    last = merged(runs.select(slot.alias("slot"), "lead", "digest", "size", F.col("doc_id").alias("keep_id"), "run", "n"), rounds, largest)
    last = last.select("digest", "size", "keep_id", F.col("run").alias("keep_run"), F.col("n").alias("group_size"))
    told = runs.select("run", "digest", "size").join(last, ["digest", "size"])
    out = rows.join(told, ["run", "digest", "size"])
    kept = (F.col("n") > 0) & (F.col("run") == F.col("keep_run"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
