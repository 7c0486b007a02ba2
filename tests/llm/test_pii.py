import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lightgraph.llm import pii, queries

from .helpers import documents, empty_documents, odd_documents, odd_rows

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15])


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["0", "1", "25", "255", ".", "@", "a.b", "-", " ", "+4", "(", ")", "a@b.c", "00", "é", "4111 1111 1111 1111", "10.0.0.1"]), max_size=25).map("".join))
def test_plain_spans_are_those_of_the_patterns(text):
    assert pii.detect(text) == brute(text)


def test_query(spark, sf):
    import hashlib

    texts = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    for r in queries.op8_pii_deobfuscation(spark, sf).collect():
        spans = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, k, _ in spans) for n in range(4))
        assert r.base_sha256 == hashlib.sha256(pii.written(spans).encode()).hexdigest()
        assert set(pii.written(spans).split(",")) - {""} <= set(r.spans.split(","))


@pytest.mark.parametrize("text, kind, span", [
    ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"), ("ask john.doe at example dot com please", "email", "john.doe at example dot com"),
    ("a(at)b(dot)org", "email", "a(at)b(dot)org"), ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"), ("user＠example．com", "email", "user＠example．com"),
    ("us​er@example.com", "email", "us​er@example.com"), ("call plus four nine one five one two three four five six seven now", "phone", "plus four nine one five one two three four five six seven"),
    ("card " + "four " + "one " * 15, "card", "four " + "one " * 14 + "one"), ("ip one nine two dot one six eight dot one dot two five four", "ip", "one nine two dot one six eight dot one dot two five four"),
    ("١٩٢.١٦٨.٠.١", "ip", "١٩٢.١٦٨.٠.١"), ("4111​1111 1111 1111", "card", "4111​1111 1111 1111"), ("x at y dot z dot de", "email", "x at y dot z dot de"),
    ("ask john dot smith at example dot com", "email", "john dot smith at example dot com"), ("ip 192 dot 168 dot 0 dot 1 up", "ip", "192 dot 168 dot 0 dot 1"),
    ("+1 (five five five) one two three four five six seven", "phone", "+1 (five five five) one two three four five six seven"), ("tel plus 49 151 2345678", "phone", "plus 49 151 2345678"),
    ("joe@mail dot example dot org", "email", "joe@mail dot example dot org"), ("+49 one five one dash two three four five six", "phone", "+49 one five one dash two three four five six"),
])
def test_disguises(text, kind, span):
    plain, more = pii.spans(text)
    assert (kind, span) in {(pii.KINDS[k], text[a:b]) for a, k, b in more}
    assert span not in pii.masked(text)


@pytest.mark.parametrize("text", ["I was at home (at night) and dot.", "five six seven people", "one two three", "He sat at the table; the point was made.", "Привет, как дела?", "номер один два", "x <at> y", "1.5 and 2.5", "(dot)", "2 plus 3 is 5", "12 dot 5", "version 1 dot 2 dot 3", "one plus two plus three"])
def test_clean_texts_stay(text):
    assert pii.spans(text) == ([], []) and pii.masked(text) == text


def test_clean_documents_gain_nothing(spark, sf):
    for r in documents(spark, sf).collect():
        assert pii.spans(r.text)[1] == []


def test_hostile_texts_take_linear_time():
    import time

    for text in ("a" * 500_000 + "@", "1" * 500_000, "1." * 250_000, "+1" * 250_000, "@a" * 250_000, "one " * 120_000, " at " * 120_000, "(at" * 160_000, "a at b dot " * 40_000):
        began = time.process_time()
        pii.spans(text)
        assert time.process_time() - began < 6


def test_redaction(spark):
    docs = odd_documents(spark)
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    r = out.where("doc_id = 10").collect()[0]
    assert r.text == "<EMAIL> and <PHONE> and <IP> and <CARD>" and r.n_chars == len(r.text)
    assert pii.redact(docs.drop("n_chars")).columns == docs.drop("n_chars").columns


def test_odd_rows(spark):
    rows = pii.find(odd_documents(spark)).collect()
    assert len(rows) == len(odd_rows())
    empty = {(r.base_sha256, r.spans) for r in rows if r.doc_id in (0, 1, 2)}
    assert len(empty) == 1 and empty.pop()[1] == ""
    assert pii.find(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("text, kind, span", [
    ("ip eight dot eight dot eight dot eight", "ip", "eight dot eight dot eight dot eight"), ("ip one zero dot zero dot zero dot one up", "ip", "one zero dot zero dot zero dot one"),
    ("tel +49 151 two three 45678", "phone", "+49 151 two three 45678"), ("card 4111 1111 1111 one one one 1", "card", "4111 1111 1111 one one one 1"),
    ("card 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
])
def test_few_spoken_digits(text, kind, span):
    test_disguises(text, kind, span)


@pytest.mark.parametrize("text", ["One. Two. Three. Four.", "one, two, three, four", "one 2 three 4 five", "one dot two dot three", "at one point 4111 people came"])
def test_counts_and_prose_stay(text):
    test_clean_texts_stay(text)


@pytest.mark.parametrize("text, span", [
    ("mail jane.doe @ example.com now", "jane.doe @ example.com"), ("mail jane.doe at example.com now", "jane.doe at example.com"), ("jane at mail.example dot com", "jane at mail.example dot com"),
    ("jane @ example.com", "jane @ example.com"), ("ask john dot smith at example.com", "john dot smith at example.com"), ("talk at jane.doe at example.com", "jane.doe at example.com"),
    ("joe@mail.example dot org", "joe@mail.example dot org"),
])
def test_only_the_at_sign_is_disguised(text, span):
    test_disguises(text, "email", span)


@pytest.mark.parametrize("text", ["look at example.com", "I saw it at example.com. Then I left.", "version 1.5 at example.com", "We met at 5.30 pm", "It ended. at example.com"])
def test_prose_with_a_plain_domain_stays(text):
    test_clean_texts_stay(text)


@pytest.mark.parametrize("text, kind, span", [
    ("ask a dot b dot c dot d dot e dot f at g dot com", "email", "a dot b dot c dot d dot e dot f at g dot com"),
    ("x a at b dot c dot d dot e dot f dot g dot h dot i dot j dot com", "email", "a at b dot c dot d dot e dot f dot g dot h dot i dot j dot com"),
    ("to " + "n" * 70 + " at example dot com", "email", "n" * 70 + " at example dot com"), ("jane" + " " * 9 + "at" + " " * 7 + "example dot com", "email", "jane" + " " * 9 + "at" + " " * 7 + "example dot com"),
    ("jane      [at]     example    (dot)    com", "email", "jane      [at]     example    (dot)    com"), ("a at " + "b" * 80 + " dot com", "email", "a at " + "b" * 80 + " dot com"),
    ("ip 10    dot   0 dot 0     dot 7", "ip", "10    dot   0 dot 0     dot 7"), ("call plus     49 151 2345678", "phone", "plus     49 151 2345678"),
    ("card 4111 1111 1111     111 - - - one", "card", "4111 1111 1111     111 - - - one"),
])
def test_no_length_is_too_long(text, kind, span):
    test_disguises(text, kind, span)


def test_a_label_that_goes_on_in_other_letters():
    assert pii.spans("jane at example dot com\u00e9 dot org")[1] == []


def test_many_addresses_take_linear_time():
    import time

    took = []
    for n in (12_500, 100_000):
        text = "a@b.co and c at d dot org, " * n
        began = time.process_time()
        plain, more = pii.spans(text)
        took.append(time.process_time() - began)
        assert len(plain) == len(more) == n
    assert took[1] < 16 * took[0] + 1


def test_hostile_disguises_take_linear_time():
    import time

    for text in ("a dot " * 100_000 + "at b", "a" + " " * 500_000 + "at" + " " * 500_000, "a at " * 100_000, "( " * 250_000, "(" + " " * 500_000, "x@" * 200_000, "x@y.z dot " * 60_000, "one" + " " * 500_000 + "two", "1 dot " * 100_000, " dot a" * 100_000 + " @ b" * 1000, "plus " * 100_000):
        began = time.process_time()
        pii.spans(text)
        assert time.process_time() - began < 6, text[:20]
