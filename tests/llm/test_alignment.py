import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lightgraph.llm import alignment, queries

from .helpers import documents, empty_documents, odd_documents, odd_rows

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
LETTERS = alignment.byte_alphabet()


def whole(text):
    """Ids and byte ends of both, of the whole text; none where they don't spell it."""
    if not text:
        return [], []
    out, plain = [], b" " + text.encode()
    for ids, spelt in (
        (A.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(LETTERS[c] for c in A.id_to_token(i))),
        (B.encode(text), lambda i: bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()),
    ):
        parts, end, row = [spelt(i) for i in ids], 0, []
        if b"".join(parts) != plain:
            return [], []
        for i, p in zip(ids, parts, strict=True):
            end += len(p)
            row.append((i, end))
        out.append(row)
    return out


def brute(rows):
    """The contract's columns for rows (doc_id, text), by whole texts and all pairs of one end."""
    tokens = [whole(t) for _, t in rows]
    links = []
    for one, two in tokens:
        at = {e: i for i, e in one}
        links.append([(at[e], b) for b, e in two if e in at])
    counts = Counter(pair for found in links for pair in found)
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for (doc_id, _), (one, two), found in zip(rows, tokens, links, strict=True):
        both_end = {e for _, e in one} & {e for _, e in two}
        sides = []
        for side in (one, two):
            cut, now = [], []
            for i, e in side:
                now.append(str(i))
                if e in both_end:
                    cut.append(",".join(now))
                    now = []
            sides.append(cut)
        groups = [f"{a}|{b}" for a, b in zip(*sides, strict=True)]
        digest = "" if not one else hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc_id, len(one), len(two), len(groups), len(found), sum(counts[p] == top[p[1]] for p in found), sum(counts[p] for p in found), digest))
    return out


def compare(df, rows):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(brute(rows), key=str)


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).orderBy("doc_id").collect()]
    got = queries.op11_cross_tokenizer_alignment(spark, sf)
    assert dict(got.dtypes) == dict.fromkeys(("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), "bigint") | {"groups_sha256": "string"}
    compare(got, rows)


def test_odd_rows(spark):
    compare(alignment.digests(odd_documents(spark)), [(i, t) for i, t, *_ in odd_rows()])
    assert alignment.digests(empty_documents(spark)).count() == 0


def test_small_batches(spark, sf):
    """Batches of a few documents give the same rows as large ones."""
    docs = documents(spark, sf).where("doc_id % 4 = 1")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(alignment.align(docs, batch_chars=500)) == rows(alignment.align(docs))


def test_rows_of_a_batch_are_bounded(spark):
    """A batch's list of distinct segments is divided over rows; documents find all of theirs."""
    rows = [(1, " ".join(f"w{i}" for i in range(40_000))), (2, " ".join(f"w{i}" for i in range(39_000, 41_000))), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    held = alignment.segmented(docs).selectExpr("batch", "size(doc_ids) AS docs", "size(segments) AS held").collect()
    assert len({r.batch for r in held}) == 1 and sum(r.docs for r in held) == 3 and sum(r.held for r in held) == 41_000
    assert max(r.held for r in held) <= 1 << 14
    compare(alignment.digests(docs), rows)


def test_popular_segments_change_nothing(spark, sf):
    """None, some and all segments told to every task."""
    docs = documents(spark, sf).where("doc_id % 3 = 0")
    rows = lambda df: sorted(map(tuple, df.collect()))
    expected = rows(alignment.align(docs))
    assert rows(alignment.align(docs, most_popular=0)) == rows(alignment.align(docs, batch_chars=9000, most_popular=300)) == expected
    counted = spark.createDataFrame([(f" w{i}", 1 + i % 50) for i in range(500)] + [("x" * 100, 900)], "segment string, n long")
    often = [r.n for r in alignment.popular(counted, 40).collect()]
    assert 10 <= len(often) <= 40 and min(often) > 45


def test_cuts_are_those_that_no_token_crosses():
    both = alignment.pair(alignment.A_FILE, alignment.B_FILE)
    assert both.cuts == " \n\t\f\v"  # B has pieces such as `;\r`
    assert both.segments("one two\r\nthree  four\n\n five  six ") == [" one", " two\r\nthree", "  four", "\n\n five", "  six "]
    assert both.segments("") == [" "] and both.segments("  ") == ["   "]


PARTS = [*"ab1.;é中 \n\t\r▁\x0b\x1c'", "\u00a0", "\u3000", "\u200b", "\u180e", "'s", " the", "  ", "\n\n", "<|endoftext|>", "<0x41>", "😀"]
MIXED = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(MIXED, st.text(max_size=30)), min_size=1, max_size=6).map("".join))
def test_segments_tokenize_as_the_whole(text):
    both = alignment.pair(alignment.A_FILE, alignment.B_FILE)
    segments = both.segments(text)
    assert "".join(segments) == " " + text
    a, b = both.tokenized(segments)
    if text:
        assert [i for ids in a for i in ids] == A.encode(" " + text, add_special_tokens=False).ids
        spelt = [b"".join(both.b_bytes[i] for i in ids) == s.encode() for s, ids in zip(segments, b, strict=True)]
        assert all(spelt) == bool(whole(text)[1])
        assert not all(spelt) or [i for ids in b for i in ids] == B.encode(text)


@pytest.mark.parametrize("text", ["word " * 200_000, "x" * 400_000, "中文" * 100_000, "a\nb " * 100_000])
def test_long_texts(spark, text):
    row = alignment.align(spark.createDataFrame([(1, text), (2, "word")], "doc_id long, text string")).where("doc_id = 1").collect()[0]
    one, two = whole(text)
    assert (row.n_a, row.n_b, row.n_groups) == (len(one), len(two), len({e for _, e in one} & {e for _, e in two}))
    assert row.groups.count(";") == row.n_groups - 1


def test_pairs_are_bounded_by_the_vocabularies(spark, sf):
    both = alignment.pair(alignment.A_FILE, alignment.B_FILE)
    assert both.most_links() < 1_500_000
    link, _, _ = alignment.pair_counts(alignment.aligned(spark.createDataFrame([(" the cat", 2), ("\n\nÉtion", 1)], "segment string, n long")), both.most_links())
    for x in link.tolist():
        a, b = both.a_bytes[x >> 32], both.b_bytes[x & 0xFFFFFFFF]
        assert a.endswith(b) or b.endswith(a)
