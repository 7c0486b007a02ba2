import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from lightgraph.llm import conversations as conv
from lightgraph.llm import queries

NAMES = {"u": "user", "a": "assistant"}
WHOLE = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """Fault of each row (turn, role, text) in order: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    seen, out = set(), []
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """(cost, audit, repaired) by a plain row-by-row search: least cost and audit for each role last retained."""
    best = {"-": (0, "", ())}
    follow = {"-": "su", "s": "u", "u": "a", "a": "u"}

    def inserts(found):
        out = dict(found)
        for _ in range(3):
            for state, (cost, audit, turns) in list(out.items()):
                for role in follow[state]:
                    if role != "s":
                        way = (cost + 3, audit + "I", (*turns, (NAMES[role], "")))
                        if role not in out or way[:2] < out[role][:2]:
                            out[role] = way
        return out

    for (_, role, text), kind in zip(rows, kinds, strict=True):
        new = {}
        for state, (cost, audit, turns) in inserts(best).items():
            options = [(state, cost + 4, audit + "D", turns)]
            if kind not in (1, 2):
                more = 3 * (kind == 3)
                if role[:1] and role[:1] in follow[state]:
                    options.append((role[:1], cost + more, audit + "K", (*turns, (role, text))))
                options += [(r, cost + 3 + more, audit + "R", (*turns, (NAMES[r], text))) for r in follow[state] if r != "s"]
            for r, *way in options:
                if r not in new or tuple(way[:2]) < new[r][:2]:
                    new[r] = tuple(way)
        best = new
    ends = inserts(best)
    return min((ends[s] for s in "-a" if s in ends), key=lambda w: w[:2])


def exhaustive(rows, kinds):
    """(cost, audit) by trying every sequence of edits of a very short conversation."""
    found = []
    for edits in product(*[["D"] if k in (1, 2) else ["D", "K", "Ru", "Ra"] for k in kinds]):
        for gaps in product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            roles, cost, audit = gaps[0], 3 * len(gaps[0]), "I" * len(gaps[0])
            for (_, role, _), kind, edit, gap in zip(rows, kinds, edits, gaps[1:], strict=True):
                cost += {"D": 4, "K": 0}.get(edit, 3) + 3 * len(gap) + 3 * (kind == 3 and edit != "D")
                roles += {"D": "", "K": role[:1]}.get(edit, edit[1:]) + gap
                audit += edit[0] + "I" * len(gap)
            if WHOLE.fullmatch(roles):
                found.append((cost, audit))
    return min(found)


def brute(rows):
    """The contract's row for the damaged rows (turn, role, text) of one conversation, in order."""
    kinds = faults(rows)
    cost, audit, turns = cheapest(rows, kinds)
    turn = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turn) - min(turn) + 1 - len(set(turn)) if turn else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return gaps, *(kinds.count(k) for k in (1, 2, 3)), illegal, cost, audit, digest


def harmed(rows):
    """The contract's damage of rows (conv_id, turn, role, text); conversations in a dict."""
    out = {}
    for c, t, role, text in rows:
        own = out.setdefault(c, [])
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fate:
            row = (t, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
            own += [row] * (2 if fate == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return {c: sorted(own, key=order) for c, own in out.items()}


def found(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


SCHEMA = "conv_id long, turn long, role string, text string, row string, digest int, kind int, audit long"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def test_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    got = queries.op12_conversation_repair(spark, sf)
    assert got.schema.simpleString() == "struct<conv_id:bigint,gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string,repaired_sha256:string>"
    assert found(got) == {c: brute(own) for c, own in harmed([(r.conv_id, r.turn, r.role, r.text) for r in rows]).items()}


def random_rows(rng, n, conv=0):
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "usher", "", None], ["Yes.", "no", "", " \n", "What?", "Oh! ", "ok.\t", None, "x"]
    text = lambda: f"Line {rng.randrange(n)}." if rng.random() < 0.5 else rng.choice(texts)
    return [(conv, rng.choice([None, *range(n)]) if rng.random() < 0.3 else i, rng.choice(roles), text()) for i in range(n)]


def test_dp_against_every_sequence_of_edits():
    rng = random.Random(1)
    for _ in range(150):
        rows = [(i, rng.choice(["system", "user", "assistant", "tool"]), "") for i in range(rng.randrange(4))]
        kinds = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in rows]
        price = exhaustive(rows, kinds)
        exits = conv.cheapest([r[:1] for _, r, _ in rows], kinds, "-")[0]
        ways = {s: w for s, w in zip(conv.STATES, exits, strict=True) if w}
        state, cost, tail = conv.ended({s: w[:2] for s, w in ways.items()})
        assert (cost, ways[state][2] + tail) == price == cheapest(rows, kinds)[:2]


@pytest.mark.parametrize("parts", ["1", "13"])
def test_conversations_cut_into_stretches(spark, parts):
    """One conversation over many range partitions, and many small ones, give the rows of the plain search."""
    rng = random.Random(int(parts))
    rows = random_rows(rng, 700, 5) + [r for c in range(10, 60) for r in random_rows(rng, rng.randrange(1, 9), c)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = rows_of(spark, rows).repartition(5)
        told = conv.stretches(conv.faults(conv.numbered(conv.damaged(df)))).where("conv_id = 5").select("stretch").distinct().count()
        assert told > 5 if parts == "13" else told == 1
        assert found(conv.report(conv.damaged(df))) == {c: brute(own) for c, own in harmed(rows).items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 3, "user", "Hi."), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 2, "", "No role."), (1, 2, "assistant", "."),
        (2, 5, "user", "x" * 300_000), (3, -4, "system", "Only."), (4, 1, "\U0001f600", "A."), (6, 7, "user", " \t\n"),
    ]
    rows += [(8, t, "user", "word. " * 9000) for t in range(6)]
    assert found(conv.report(conv.damaged(rows_of(spark, rows)))) == {c: brute(own) for c, own in harmed(rows).items()}
    assert conv.report(conv.damaged(rows_of(spark, []))).count() == 0
    assert conv.repaired(conv.plain(rows_of(spark, []))).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Cut off"), (2, 0, "user", "Why?"), (2, 1, "assistant", "So.")]
    got = sorted(((r.conv_id, r.position, r.turn, r.role, r.text, r.edit) for r in conv.repaired(conv.plain(rows_of(spark, rows))).collect()), key=str)
    plain = {c: [r[1:] for r in rows if r[0] == c] for c in (1, 2)}
    for c, own in plain.items():
        _, audit, turns = cheapest(own, faults(own))
        mine = sorted((g for g in got if g[0] == c and g[1] is not None), key=lambda g: g[1])
        assert [(g[3], g[4]) for g in mine] == list(turns)
        assert sorted(g[5] for g in got if g[0] == c) == sorted(audit)
        assert all((g[2] is None) == (g[5] == "I") for g in got if g[0] == c)
