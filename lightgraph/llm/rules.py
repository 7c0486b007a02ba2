"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source.

One pass over the texts counts words, symbols, repeated lines and repeated windows. Each measure
goes into a log-linear histogram: exact below 32, then 16 buckets an octave, so a bucket's value
is within 1/16. Such sketches merge by adding counts, in any order, which a plain groupBy does
with map-side sums. A (language, source) with too few documents uses its language's merged
sketch, or else that of all. The fences are the quartiles of the sketch plus three interquartile
ranges (a least range keeps uniform groups from losing ordinary documents), and a join with the
fences filters the documents.

Defined cases: a null text has no words, so it fails the base rule; a null language or source is
a group of its own; repeated rows count and are judged one by one; an empty table gives an empty
result; only doc_id, text, lang and source are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_batches

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 5
#: Beyond so many words the windows are ranked with numpy, in memory proportional to the text.
MANY = 20_000
#: Fewer documents than this in a group: the group's language decides, then all documents.
LEAST_DOCS = 100
#: Interquartile ranges beyond the quartile, and the least range of each measure.
FENCE = 3.0
LEAST_RANGE = {"symbols_per_1000": 30, "dup_lines_per_1000": 60, "repeats_per_1000": 60, "chars_per_100_words": 60}
#: Only the mean word length can also be too low; of fewer words than FEW it says less, so its fences are wider in proportion.
TWO_SIDED = ("chars_per_100_words",)
FEW = 50


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of WINDOW words found twice or more, its first place included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if len(words) <= MANY:
        grams = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(grams)) == n:
            return 0
        seen: set = set()
        again = {g for g in grams if g in seen or seen.add(g)}
        twice = np.fromiter((g in again for g in grams), bool, n)
    else:
        ids: dict[bytes, int] = {}
        rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        one = rank
        for i in range(1, WINDOW):  # ranks of windows of i + 1 words, exactly
            pair = rank[: len(one) - i] if i == 1 else grown[: len(one) - i]
            grown = np.unique(pair * np.int64(len(ids)) + one[i:], return_inverse=True)[1].astype(np.int64)
        twice = np.bincount(grown)[grown] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the lines that have a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes split at ASCII white space only
    chars = len(text) - sum(text.count(c) for c in SPACES)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), dup, repeated_words(words), lines


def bucket(x: int) -> int:
    """Log-linear bucket of a count: x itself below 32, then 16 buckets an octave."""
    if x < 32:
        return x
    e = x.bit_length() - 5
    return 16 * e + (x >> e)


def bucket_value(column):
    """Lower end of a bucket, as a column."""
    e = F.floor(column / 16) - 1
    return F.when(column < 32, column.cast("double")).otherwise((column - 16 * e) * F.pow(F.lit(2.0), e))


MEASURES = tuple(LEAST_RANGE)


def measure(docs: DataFrame) -> DataFrame:
    """The counts of every document and the bucket of each measure; whole texts, one pass, no shuffle."""

    def make():
        def run(batch):
            out: list[list] = [[] for _ in range(6 + len(MEASURES))]
            for text in batch.column("text").to_pylist():
                n, chars, symbols, dup, repeats, lines = row = counts(text)
                scaled = (1000 * symbols // n, 1000 * dup // max(lines, 1), 1000 * repeats // n, 100 * chars // n) if n else (0, 0, 0, None)
                failed = n < 10 or 100 * repeats > 20 * n
                for at, x in zip(out, (*row[:5], failed, *(x if x is None else bucket(x) for x in scaled)), strict=True):
                    at.append(x)
            return [batch.column("doc_id"), batch.column("lang"), batch.column("source"), *out]

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    return map_batches(
        rows, make,
        "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, " + ", ".join(f"{m} int" for m in MEASURES),
    )


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket) -> documents; adding the counts of two tables merges them."""
    stacked = ", ".join(f"'{m}', {m}" for m in MEASURES)
    long = measured.where("not base_failed").selectExpr("lang", "source", f"stack({len(MEASURES)}, {stacked}) as (measure, bucket)").where("bucket is not null")
    return long.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("docs"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Lower and upper quartile of each sketch: the bucket in which a quarter, or three, of the documents are reached."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("docs").alias("docs"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("upto", F.sum("docs").over(group.orderBy("bucket"))).withColumn("total", F.sum("docs").over(group))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), F.col("bucket")))
    return ranked.groupBy(*keys, "measure").agg(at(0.25).alias("b1"), at(0.75).alias("b3"), F.max("total").alias("total"))


def fences(sketch: DataFrame) -> DataFrame:
    """A row for each (lang, source) with low_<measure>, high_<measure> and how far these are from the quartiles, spread_<measure>."""
    groups = sketch.select("lang", "source").distinct()
    levels = [quartiles(sketch, ["lang", "source"]), quartiles(sketch, ["lang"]), quartiles(sketch, [])]
    measures = F.array(*(F.struct(F.lit(m).alias("measure"), F.lit(float(r)).alias("least"), F.lit(m in TWO_SIDED).alias("both")) for m, r in LEAST_RANGE.items()))
    own = groups.select("lang", "source", F.explode(measures).alias("m")).select("lang", "source", "m.*")
    for i, (level, keys) in enumerate(zip(levels, (["lang", "source"], ["lang"], []), strict=True)):
        named = level.select(*(F.col(k).alias(f"{k}_{i}") for k in keys), F.col("measure").alias(f"measure_{i}"), F.struct("b1", "b3", "total").alias(f"q_{i}"))
        on = F.col("measure") == F.col(f"measure_{i}")
        for k in keys:
            on &= F.col(k).eqNullSafe(F.col(f"{k}_{i}"))
        own = own.join(named, on, "left")
    q = F.when(F.col("q_0.total") >= LEAST_DOCS, F.col("q_0")).when(F.col("q_1.total") >= LEAST_DOCS, F.col("q_1")).otherwise(F.col("q_2"))
    own = own.withColumn("q", q).withColumn("v1", bucket_value(F.col("q.b1"))).withColumn("v3", bucket_value(F.col("q.b3")))
    spread = F.greatest(F.col("v3") - F.col("v1"), F.col("least")) * FENCE
    own = own.withColumn("spread", spread).withColumn("high", F.col("v3") + F.col("spread")).withColumn("low", F.when(F.col("both"), F.col("v1") - F.col("spread")))
    return own.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}") for m in MEASURES for side in ("low", "high", "spread")))


def judge(docs: DataFrame) -> DataFrame:
    """The contract's counts, base_failed and kept for every document."""
    measured = materialize(measure(docs), "rules")
    limits = fences(sketches(measured)).withColumnsRenamed({"lang": "lang_", "source": "source_"})
    ok = ~F.col("base_failed")
    for m in MEASURES:
        x, more = bucket_value(F.col(m)), F.lit(0.0)
        if m in TWO_SIDED:
            more = F.col(f"spread_{m}") * F.greatest(F.lit(0.0), F.lit(float(FEW)) / F.greatest("n_words", F.lit(1)) - 1)
        ok &= F.coalesce(x <= F.col(f"high_{m}") + more, F.lit(True)) & F.coalesce(x >= F.col(f"low_{m}") - more, F.lit(True))
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(ok, F.lit(False)).alias("kept"))
