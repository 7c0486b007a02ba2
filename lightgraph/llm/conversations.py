"""Conversation structure repair by a DP over the retained turns.

A row of a conversation is kept, gets another role, or is deleted, and empty turns are inserted, so
that the roles read: a system turn or none, then user and assistant in turn, or nothing at all. The
cheapest edits are sought; of equally cheap ones those whose initials (D, I, K, R) come first.

Rows go by conversation and turn (null turns first; rows of one turn by a digest of role and text).
A row's first fault counts: blank, duplicate (role and text stood in an earlier row), truncated.
Duplicates are found by the first row of each (conversation, role, text), joined back by row, so
that a text repeated without end is no hot key.

The DP runs over stretches: what a range partition, cut anywhere, holds of a conversation. For each
role that may stand before a stretch, the running minimum of every state (the role last retained)
less the deletions up to there prices a gap: the deletions between are a difference of prefix sums,
and the pair of roles says what has to be inserted. Equal prices are settled by the ranks of the
audits so far: none is the beginning of another, as all have an edit for each row, so the first
difference decides. A conversation within one partition, as nearly all are, is done there.
Stretches of a longer one are 4 x 4 tables of price and rank, folded in order without their audits;
only the audits on the cheapest way are read then.

Texts are edited in a stream: a conversation's audit, then its rows in order. SHA-256 is sequential,
so the texts of one conversation pass through one task, which holds a batch of them and the audit.

Defined cases: null roles and texts are one space; a null conv_id is a conversation, null turns
come first and don't count for gaps; a role without characters, and one that begins with none of
s, u, a, can't be kept; repeated rows are duplicates; a conversation of which nothing is left has
zeros and empty strings; an empty table gives an empty result; only conv_id, turn, role and text
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}
BLANK = r"[^\x20\x09-\x0D]"
COMPLETE = r"[.!?][\x20\x09-\x0D]*\z"

#: States: nothing retained yet, or the last retained role.
STATES = "-sua"
#: Empty turns between the last retained role and the next, and behind the last one. A system turn comes first or never.
INSERTS = {("-", "s"): 0, ("-", "u"): 0, ("-", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "u"): 1, ("u", "a"): 0, ("a", "u"): 0, ("a", "a"): 1}
AT_END = {"-": 0, "s": 2, "u": 1, "a": 0}

Way = tuple[int, int, str]  # price, rank among the ways from the same state, audit


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: (conv_id, turn, role, text, gone, row); dropped rows stay as gone, so that no conversation is lost."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    fate = F.crc32(F.concat_ws(":", F.coalesce(conv.cast("string"), F.lit(" ")), F.coalesce(turn.cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    return rows.select(
        conv.alias("conv_id"), turn.alias("turn"), F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fate == 0).alias("gone"), F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def plain(rows: DataFrame) -> DataFrame:
    """Conversations as they are, in the form of damaged(): nulls are one space, nothing is gone."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text, F.lit(False).alias("gone"))


def numbered(rows: DataFrame) -> DataFrame:
    """Written with a number and a digest for each row: what orders the rows of a turn, and what duplicates share."""
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return materialize(rows.select("*", F.unhex(digest).alias("digest"), F.monotonically_increasing_id().alias("row")), "conversations-rows")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, row, initial, fault) of the rows that are not gone; fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    left = rows.where("not gone")
    place = F.struct("turn", "row")  # equal rows have one digest, so turn and row order them
    first = left.groupBy("conv_id", "digest").agg(F.min(place).alias("place")).select(F.col("place.row").alias("row"), F.lit(True).alias("first"))
    blank = ~F.col("text").rlike(BLANK)
    told = left.select("conv_id", "turn", "digest", "row", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), F.col("text").rlike(COMPLETE).alias("complete"))
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(~F.col("complete"), 3).otherwise(0)
    return told.join(first, "row", "left").select("conv_id", "turn", "digest", "row", "initial", fault.alias("fault"))


def cheapest(initials: list[str], faulty: list[int], entries: str) -> list[list[Way | None]]:
    """For each entry state, the best way to each exit state over a stretch of rows; None where there is none."""
    n, out = len(initials), []
    deletions = [0]
    for _ in initials:
        deletions.append(deletions[-1] + DELETE)  # prefix sums
    for entry in entries:
        # Of each state: the least price less the deletions up to there, that audit's rank, and the choice (row, before, edit) behind it.
        least: dict[str, tuple[int, int]] = {entry: (0, 0)}
        last: dict[str, int] = {entry: -1}
        back: list[dict[str, tuple[str, int, str]]] = []  # at a retained row: state before, its row, edits of this row
        for i in range(n):
            own, made = TRUNCATED * (faulty[i] == 3), {}
            if faulty[i] not in (1, 2):
                edits = [(initials[i], 0, "K")] if initials[i] in ("s", "u", "a") else []
                for role, price, edit in [*edits, ("u", REROLE, "R"), ("a", REROLE, "R")]:
                    for state, (price_before, rank) in least.items():
                        if (inserts := INSERTS.get((state, role))) is not None:
                            way = (price_before + deletions[i] + own + price + INSERT * inserts, rank, "I" * inserts + edit, state)
                            if role not in made or way < made[role]:
                                made[role] = way
            # The minima now: deleting this row too, or the way that retains it. A way's audit so far is that of `rank` and then its edits.
            ways = {s: (price, rank, "D", None) for s, (price, rank) in least.items()}
            for role, (price, rank, edits, state) in made.items():
                price -= deletions[i + 1]
                if role not in ways or (price, rank, edits) < ways[role][:3]:
                    ways[role] = (price, rank, edits, state)
            ranks = {x: k for k, x in enumerate(sorted({(rank, edits) for _, rank, edits, _ in ways.values()}))}
            least = {s: (price, ranks[rank, edits]) for s, (price, rank, edits, _) in ways.items()}
            row = {s: (state, last[state], edits) for s, (_, _, edits, state) in ways.items() if state is not None}
            last |= dict.fromkeys(row, i)
            back.append(row)
        exits: list[Way | None] = []
        for state in STATES:
            if state not in least:
                exits.append(None)
                continue
            parts, s, i, upto = [], state, last[state], n
            while i >= 0:
                before, i_before, edits = back[i][s]
                parts.append(edits + "D" * (upto - i - 1))
                s, upto, i = before, i, i_before
            parts.append("D" * upto)
            exits.append((least[state][0] + deletions[n], least[state][1], "".join(reversed(parts))))
        out.append(exits)
    return out


def ended(exits: dict[str, tuple[int, int]]) -> tuple[str, int, str]:
    """The cheapest last state of a conversation from (price, rank) of each, its price, and the empty turns behind it."""
    price, _, tail, state = min((price + INSERT * AT_END[s], rank, "I" * AT_END[s], s) for s, (price, rank) in exits.items())
    return state, price, tail


STRETCHES = "conv_id long, stretch long, blank long, duplicate long, truncated long, entry string, exit string, price long, rank int, audit string"


def stretches(told: DataFrame) -> DataFrame:
    """Of each stretch of a conversation the ways through it. One that can't go on in another partition is settled: its exit is null."""
    kind = pa.schema([(c, pa.string() if t == "string" else pa.int32() if t == "int" else pa.int64()) for c, t in (part.split() for part in STRETCHES.split(", "))])

    def ways(conv: int | None, stretch: int, initials: list[str], faulty: list[int], cut: bool) -> Iterator[tuple]:
        counts = [faulty.count(f) for f in (1, 2, 3)]
        for entry, exits in zip(STATES, cheapest(initials, faulty, STATES if cut else STATES[:1]), strict=False):
            found = {s: way for s, way in zip(STATES, exits, strict=True) if way}
            if not cut:
                state, price, tail = ended({s: way[:2] for s, way in found.items()})
                yield conv, stretch, *counts, entry, None, price, 0, found[state][2] + tail
                return
            for s, way in found.items():
                yield conv, stretch, *counts, entry, s, *way

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, now, initials, faulty, out = TaskContext.get().partitionId() << 32, 0, None, [], [], []
        for batch in batches:
            for conv, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "initial", "fault")), strict=True):
                if initials and conv != now:
                    out += ways(now, own + number, initials, faulty, number == 0)  # the first may have begun in the partition before
                    number, initials, faulty = number + 1, [], []
                now = conv
                initials.append(initial)
                faulty.append(fault)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
                out = []
        if initials:  # the last may go on in the next
            out += ways(now, own + number, initials, faulty, True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    order = ["conv_id", "turn", "digest", "row"]
    return told.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(work, STRETCHES)


def folded(table: pa.Table) -> pa.Table:
    """The cheapest way of one conversation through its stretches: for each its entry and exit; price and tail at the last."""
    by: dict[int, list[tuple]] = {}
    for r in table.to_pylist():
        by.setdefault(r["stretch"], []).append((r["entry"], r["exit"], r["price"], r["rank"]))
    live, back = {"-": (0, 0)}, []
    for stretch in sorted(by):
        best: dict[str, tuple] = {}
        for entry, leave, price, rank in by[stretch]:
            if entry in live:
                way = (live[entry][0] + price, live[entry][1], rank, entry)
                if leave not in best or way < best[leave]:
                    best[leave] = way
        ranks = {x: k for k, x in enumerate(sorted(way[1:3] for way in best.values()))}
        live = {s: (way[0], ranks[way[1:3]]) for s, way in best.items()}
        back.append((stretch, {s: way[3] for s, way in best.items()}))
    state, price, tail = ended(live)
    out = []
    for stretch, before in reversed(back):
        out.append((table.column("conv_id")[0].as_py(), stretch, before[state], state, price, tail))
        state, price, tail = before[state], 0, ""
    names = ("conv_id", "stretch", "entry", "exit", "total", "tail")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.table({c: pa.array(v, t) for c, t, v in zip(names, kinds, zip(*out, strict=True), strict=True)})


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, cost, audit) of every conversation that numbered rows are left of."""
    found = materialize(stretches(faults(rows)), "conversations-stretches")
    counts = ["blank", "duplicate", "truncated"]
    whole = found.where("exit is null").select("conv_id", "stretch", *counts, "price", "audit")
    cut = found.where("exit is not null")
    way = cut.select("conv_id", "stretch", "entry", "exit", "price", "rank").groupBy("conv_id").applyInArrow(folded, "conv_id long, stretch long, entry string, exit string, total long, tail string")
    taken = way.join(cut.select("stretch", "entry", "exit", *counts, "audit"), ["stretch", "entry", "exit"])
    parts = whole.unionByName(taken.select("conv_id", "stretch", *counts, F.col("total").alias("price"), F.concat("audit", "tail").alias("audit")))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "audit"))), lambda x: x["audit"]), "")
    return parts.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in counts), F.sum("price").alias("cost"), audit.alias("audit"))


def read(batches: Iterator[pa.RecordBatch], begin: Callable, turn: Callable, end: Callable) -> Iterator[list]:
    """Calls begin(head row) for each conversation, turn(row or None, role, text, edit) for each edit in order, and end(); yields after a batch."""
    head, audit, at, last = None, "", 0, "-"

    def role_next(retained: str) -> str:
        return "assistant" if retained == "u" else "user"

    def inserted(last: str, at: int) -> tuple[str, int]:
        while at < len(audit) and audit[at] == "I":
            turn(None, role_next(last), "", "I")
            last, at = "a" if last == "u" else "u", at + 1
        return last, at

    for batch in batches:
        for row in batch.to_pylist():
            if head is None or row["conv_id"] != head["conv_id"]:
                if head is not None:
                    inserted(last, at)
                    end()
                head, at, last, audit = row, 0, "-", row["audit"] or ""
                begin(head)
            if row["gone"] is not False:  # a head, or a dropped row
                continue
            last, at = inserted(last, at)
            edit = audit[at]
            at += 1
            role = role_next(last) if edit == "R" else row["role"]
            turn(row, role, row["text"], edit)
            last = last if edit == "D" else role[0]
        yield []
    if head is not None:
        inserted(last, at)
        end()
        yield []


def streamed(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work over each conversation's audit and then its rows, in order; a conversation is never divided."""
    heads = audits(rows).withColumns({"kind": F.lit(0), "gone": F.lit(None).cast("boolean")})
    both = heads.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest", "row").drop("digest", "row").mapInArrow(work, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The turns after repair, and those deleted: (conv_id, position, turn, role, text, edit); a deleted one has no position, an inserted one no turn.
    rows: of plain() or damaged()."""
    kind = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, out = None, 0, []

        def begin(head: dict) -> None:
            nonlocal conv, position
            conv, position = head["conv_id"], 0

        def turn(row: dict | None, role: str, text: str, edit: str) -> None:
            nonlocal position
            out.append((conv, None if edit == "D" else position, row and row["turn"], role, text, edit))
            position += edit != "D"

        for _ in read(batches, begin, turn, lambda: None):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
                out.clear()

    return streamed(numbered(rows), work, "conv_id long, position long, turn long, role string, text string, edit string")


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(rows: DataFrame) -> DataFrame:
    """For each conversation its faults, the cost and the audit of the repair, and a digest of the repaired turns. rows: of plain() or damaged()."""
    names = [part.split()[0] for part in REPORT.split(", ")]
    kind = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = [], {}

        def begin(head: dict) -> None:
            now.update(head=head, digest=hashlib.sha256(), separator="", initial=None, illegal=0, low=None, high=0, turns=0)

        def turn(row: dict | None, role: str, text: str, edit: str) -> None:
            if edit != "D":
                now["digest"].update(f"{now['separator']}{role}:{text}".encode())
                now["separator"] = "\n"
            if row is not None:
                initial = row["role"][:1]
                now["illegal"] += now["initial"] is not None and now["initial"] + initial not in LEGAL
                now["initial"] = initial
                if row["turn"] is not None and (now["low"] is None or row["turn"] != now["high"]):
                    now.update(low=row["turn"] if now["low"] is None else now["low"], high=row["turn"], turns=now["turns"] + 1)

        def end() -> None:
            head = now["head"]
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
            counts = [head[c] or 0 for c in ("blank", "duplicate", "truncated")]
            out.append((head["conv_id"], gaps, *counts, now["illegal"], head["cost"] or 0, head["audit"] or "", now["digest"].hexdigest()))

        for _ in read(batches, begin, turn, end):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
                out.clear()

    return streamed(numbered(rows), work, REPORT)
