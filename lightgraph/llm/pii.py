"""Personal data with offset-preserving deobfuscation.

Plain detection finds e-mail addresses, IP addresses, card numbers and telephone numbers. Then
transducers rewrite disguises (look-alike characters, digits spelled as words, at and dot in
words or brackets) into a normalised text that remembers which source characters each of its
characters came from; detection runs again there and the spans map back to the source. Only spans
that a rewrite touched are added; plain ones stay.

All scans are linear in the text, whatever it holds: no pattern restarts inside a run that it
has already rejected.

Defined cases: a null text is empty; spans count code points, ends exclusive; repeated rows are
scanned one by one; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, place of its kind in KINDS, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
SPACED = re.compile(r"[0-9](?:[ -]?[0-9])*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        x = int(d) * (1 + n % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Plain spans, sorted; matches of one kind don't overlap, and failing ones are dropped."""
    spans: list[Span] = []
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            spans.append((start, 0, m.end()))
            past = m.end()
        at = text.find("@", max(at + 1, past))
    for m in DOTTED.finditer(text):
        if m.end() - m.start() >= 7 and "." in m[0]:
            runs = list(DIGITS.finditer(text, m.start(), m.end()))
            for i in range(0, len(runs) - 3, 4):  # a chain of numbers is taken four by four
                if all(len(p := r[0].lstrip("0")) <= 3 and int(p or 0) <= 255 for r in runs[i : i + 4]):
                    spans.append((runs[i].start(), 1, runs[i + 3].end()))
    for m in SPACED.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(len(x) for x in DIGITS.findall(m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


# Characters that look like an ASCII one, in the order of the ASCII characters.
LOOK_ALIKES = (
    ("a", "аɑα"), ("b", "Ьʙ"), ("c", "сϲ"), ("d", "ԁ"), ("e", "еҽ"), ("g", "ɡ"), ("h", "һ"), ("i", "іıι"), ("j", "ј"), ("k", "κк"), ("l", "ӏⅼ"),
    ("m", "мⅿ"), ("n", "ո"), ("o", "оοօ"), ("p", "рρ"), ("q", "ԛ"), ("r", "г"), ("s", "ѕ"), ("t", "т"), ("u", "υս"), ("v", "νѵ"), ("w", "ԝω"),
    ("x", "хχ"), ("y", "уγ"), ("z", "ᴢ"), ("A", "АΑ"), ("B", "ВΒ"), ("C", "СϹ"), ("E", "ЕΕ"), ("H", "НΗ"), ("I", "ІΙ"), ("J", "Ј"), ("K", "КΚ"),
    ("M", "МΜ"), ("N", "Ν"), ("O", "ОΟ"), ("P", "РΡ"), ("S", "Ѕ"), ("T", "ТΤ"), ("X", "ХΧ"), ("Y", "ҮΥ"), ("Z", "Ζ"),
    (".", "․。﹒‚"), ("-", "‐‑‒–—―−﹣"), ("@", "﹫"), ("+", "﹢"),
    (" ", "              　"), ("", "­​‌‍⁠﻿"),
)
PLAIN = {c: to for to, every in LOOK_ALIKES for c in every} | {chr(0xFF00 + c - 0x20): chr(c) for c in range(0x21, 0x7F)}
ODD = re.compile("[" + re.escape("".join(PLAIN)) + "]|[^\x00-\x7f0-9\\W_a-zA-Z]")
# Words of digits, in the order of the digits; the last three stand for a plus sign, a dot and a dash.
DIGIT_WORDS = (
    ("0", "zero oh null cero zéro"), ("1", "one eins uno un"), ("2", "two zwei zwo dos deux"), ("3", "three drei tres trois"), ("4", "four vier cuatro quatre"),
    ("5", "five fünf cinco cinq"), ("6", "six sechs seis"), ("7", "seven sieben siete sept"), ("8", "eight acht ocho huit"), ("9", "nine neun nueve neuf"),
    ("+", "plus"), (".", "dot point punkt punto"), ("-", "dash hyphen minus"),
)
SPOKEN = {w: d for d, words in DIGIT_WORDS for w in words.split()}
#: Digits of a spoken run from which on ends of sentences in it may be dots; in shorter ones they are those of a count ('One. Two.').
LISTED = 7
_word = "|".join(sorted(SPOKEN, key=len, reverse=True))
SPOKEN_RUN = re.compile(rf"(?<![^\W_])(?:{_word}|[0-9]++)(?:[ ,./()\t-]++(?:{_word}|[0-9]++)(?![^\W_]))++", re.I)
SPOKEN_PART = re.compile(rf"(?:{_word})|[0-9]+", re.I)
# Words for the at sign and the dot.
_at, _dot = "at|@|arroba|arobase|klammeraffe", "dot|\\.|punkt|punto|point"
BRACKETED = re.compile(rf"[\[({{<][ \t]*+(?:(?P<at>{_at})|(?P<dot>{_dot}))[ \t]*+[\])}}>][ \t]*+", re.I)
_gap = "[ \\t]++"
#: An at sign between two words, plain or disguised; what stands before and after it is read outwards from there.
AT = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?:[ \t]++(?:{_at})[ \t]++|@)(?=[A-Za-z0-9-])", re.I)
REST = re.compile(rf"[A-Za-z0-9-]++(?:(?:{_gap}(?:{_dot}){_gap}|\.)[A-Za-z0-9-]++)*+", re.I)
LAST_DOT = re.compile(rf"(?:{_gap}(?:{_dot}){_gap}|\.)", re.I)
#: With a plain domain, a spaced at sign is enough; a worded one needs a local part with a dot in it, as 'look at example.com' is prose.
DOTTED_LOCAL = re.compile(rf"[A-Za-z][A-Za-z0-9_%+-]*+(?:(?:\.|{_gap}(?:{_dot}){_gap})[A-Za-z0-9_%+-]++)++", re.I)
NUMBERS = re.compile(rf"(?<![0-9.])[0-9]++(?:{_gap}(?:{_dot}){_gap}[0-9]++){{3}}", re.I)
PLUS = re.compile(r"(?<![^\W_])plus[ \t]++(?=[0-9][ ().0-9-]{7})", re.I)
WORDED_DOT = re.compile(rf"{_gap}(?:{_dot}){_gap}", re.I)
DOT_WORDS = frozenset(_dot.replace("\\", "").split("|"))


class Rewritten:
    """A text after edits (start, end, replacement), and the way back to its source."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]) -> None:
        out, self.at, self.from_, self.kept = [], [], [], []
        done = size = 0
        for start, end, new in [*edits, (len(source), len(source), "")]:
            for piece, a, b, kept in ((source[done:start], done, start, True), (new, start, end, False)):
                if piece:
                    self.at.append(size)
                    self.from_.append((a, b))
                    self.kept.append(kept)
                    out.append(piece)
                    size += len(piece)
            done = end
        self.text = "".join(out)
        self.edited = bool(edits)

    def place(self, i: int) -> tuple[int, int]:
        """The source characters of character i."""
        k = bisect_right(self.at, i) - 1
        a, b = self.from_[k]
        return (a + i - self.at[k], a + i - self.at[k] + 1) if self.kept[k] else (a, b)

    def touched(self, start: int, end: int) -> bool:
        """Whether an edit lies between two characters, or removed something there."""
        a, b = self.place(start)[0], self.place(end - 1)[1]
        return b - a != end - start or any(not self.kept[k] for k in range(bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1)))


def _characters(text: str) -> list[tuple[int, int, str]]:
    edits = []
    if not text.isascii():
        for m in ODD.finditer(text):
            c = m[0]
            if c in PLAIN:
                edits.append((m.start(), m.end(), PLAIN[c]))
            elif (d := unicodedata.decimal(c, None)) is not None:
                edits.append((m.start(), m.end(), str(d)))
    return edits


#: Punctuation that may stand between spoken digits, as spaces.
SPLIT = bytes(32 if c in b"\t\r\n,./-()[]{}<>:;!?" else c for c in range(256))
SPOKEN_BYTES = frozenset(w.encode() for w in SPOKEN)
AT_BYTES, DOT_BYTES = (frozenset(w.encode() for w in words.replace("\\", "").split("|")) for words in (_at, f"{_dot}|"))


def _words(low: str) -> list[bytes]:
    return low.encode().translate(SPLIT).split()


def _spoken(text: str, words: list[bytes]) -> list[tuple[int, int, str]]:
    """Runs with a spoken digit or sign that are an identifier once written in digits."""
    if SPOKEN_BYTES.isdisjoint(words):
        return []
    edits = []
    for run in SPOKEN_RUN.finditer(text):
        parts = [(m.start(), m.end(), SPOKEN.get(m[0].lower(), m[0])) for m in SPOKEN_PART.finditer(text, run.start(), run.end())]
        while parts and parts[-1][2] in ".+-":
            parts.pop()
        while parts and parts[0][2] in ".-":
            parts.pop(0)
        digits = sum(len(p[2]) for p in parts if p[2].isdigit())
        if digits < 4 or all(text[a:b] == new for a, b, new in parts):
            continue
        own, listed = [], False
        before = text[max(0, parts[0][0] - 3) : parts[0][0]]
        normal = [before[before.rfind("+") :]] if "+" in before else []
        for n, (a, b, new) in enumerate(parts):
            if n and a > parts[n - 1][1]:
                between = text[parts[n - 1][1] : a]
                dot = "." if "." in between and new.isdigit() and parts[n - 1][2].isdigit() else ""
                listed |= bool(dot) and between[0] == "." and len(between) > 1
                own.append((parts[n - 1][1], a, dot))
                normal.append(dot)
            normal.append(new.replace("-", ""))
            if text[a:b] != new:
                own.append((a, b, new.replace("-", "")))  # a spoken dash only parts digits
        if (digits >= LISTED or not listed) and detect("".join(normal)):
            edits += own
    return edits


def _before(text: str, at: int, past: int) -> int:
    """Where the local part that ends at `at` begins, not before `past`: characters of one, and dots in words between such."""
    start = at
    while True:
        while start > past and text[start - 1] in LOCAL:
            start -= 1
        i = start
        while i > past and text[i - 1] in " \t":
            i -= 1
        j = i
        while j > past and (text[j - 1].isalpha() or text[j - 1] == "."):
            j -= 1
        k = j
        while k > past and text[k - 1] in " \t":
            k -= 1
        if not (i < start and j < i and k < j and k > past and text[k - 1] in LOCAL and text[j:i].lower() in DOT_WORDS):
            return start
        start = k


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits of disguised addresses, from one at sign to the next; each part of the text is read by the two signs next to it at most."""
    edits: list[tuple[int, int, str]] = []
    past, m = 0, AT.search(text)
    while m:
        start, rest = _before(text, m.start(), past), REST.match(text, m.end())
        end = rest.end()
        if end < len(text) and text[end] != "_" and text[end].isalnum():  # the last label goes on in other letters
            dots = list(LAST_DOT.finditer(text, m.end(), end))
            end = dots[-1].start() if dots else m.end()
        dots = list(LAST_DOT.finditer(text, m.end(), end))
        worded = [d for d in dots if d[0] != "."]
        spaced = m[0] != "@" and (m[0].strip() == "@" or DOTTED_LOCAL.fullmatch(text, start, m.start()))
        if dots and start < m.start() and (spaced or worded):
            edits += [(d.start(), d.end(), ".") for d in WORDED_DOT.finditer(text, start, m.start())]
            edits += [(m.start(), m.end(), "@"), *((d.start(), d.end(), ".") for d in worded)]
            past = end
            m = AT.search(text, end)
        else:
            past = m.start() if m[0] == "@" else m.end()
            m = AT.search(text, m.end())
    return edits


def _bracketed(text: str) -> list[tuple[int, int, str]]:
    edits, past = [], 0
    for m in BRACKETED.finditer(text):
        start = m.start()
        while start > past and text[start - 1] in " \t":
            start -= 1
        past = m.end()
        edits.append((start, past, "@" if m["at"] else "."))
    return edits


def _worded(text: str, words: list[bytes]) -> list[tuple[int, int, str]]:
    edits = []
    if any(c in text for c in "[({<"):
        edits += _bracketed(text)
    found = set(words)
    if "@" in text or not AT_BYTES.isdisjoint(found):
        edits += _addresses(text)
    if not DOT_BYTES.isdisjoint(found) or " . " in text:
        edits += [(d.start(), d.end(), ".") for m in NUMBERS.finditer(text) for d in WORDED_DOT.finditer(text, m.start(), m.end())]
    if b"plus" in found:
        edits += [(m.start(), m.end(), "+") for m in PLUS.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for e in sorted(edits):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def deobfuscated(text: str, plain: list[Span]) -> list[Span]:
    """Spans of the source that only show after the rewrites, one after the other."""
    steps: list[Rewritten] = []
    now, words = text, None
    for find in (lambda t, _: _characters(t), _spoken, _worded):
        if words is None and find in (_spoken, _worded):
            words = _words(now.lower())
        edits = find(now, words)
        if edits:
            steps.append(Rewritten(now, edits))
            now, words = steps[-1].text, None
    if not steps:
        return []
    found = []
    own = [[(s, e) for s, k, e in plain if k == n] for n in range(len(KINDS))]  # by kind they are in order and apart
    for start, kind, end in detect(now):
        if kind == 0 and not now[start:end].rsplit(".", 1)[1].isalpha():
            continue  # a disguised address ends in letters
        a, b, touched = start, end, False
        for step in reversed(steps):
            touched |= step.touched(a, b)
            a, b = step.place(a)[0], step.place(b - 1)[1]
        before = bisect_right(own[kind], (a, len(text)))
        if touched and not (before and b <= own[kind][before - 1][1]):
            found.append((a, kind, b))
    return found


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans, and those that the rewrites add."""
    if not text:
        return [], []
    plain = detect(text)
    return plain, deobfuscated(text, plain)


def written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, plain counts by kind, digest of the plain spans, all spans."""

    def make():
        def run(batch):
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                plain, more = spans(text)
                row = [sum(k == n for _, k, _ in plain) for n in range(4)]
                for to, v in zip(out, (*row, hashlib.sha256(written(plain).encode()).hexdigest(), written(plain + more)), strict=True):
                    to.append(v)
            return [batch.column("doc_id"), *out]

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str | None) -> str | None:
    """The text with every span, overlapping ones as one, replaced by the kind in angle brackets."""
    if not text:
        return text
    plain, more = spans(text)
    out, done = [], 0
    for a, k, b in sorted(plain + more, key=lambda s: (s[0], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{KINDS[k].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked in text, and n_chars, where there is one, counted anew."""
    schema, names = docs.schema, docs.columns

    def run(batches):
        for batch in batches:
            text = batch.column(names.index("text"))
            new = pa.array([masked(t) for t in text.to_pylist()], text.type)
            columns = [new if n == "text" else c for n, c in zip(names, batch.columns, strict=True)]
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([None if t is None else len(t) for t in new.to_pylist()], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
