"""Scalar formulas as column expressions: directions, vectors, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import BINS, LightParams
from .lookups import property_bin

#: Norms below it count as zero.
TINY = 1e-10


def angular_distance(a: Column, b: Column, bins: int = BINS) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(bins) - d)


def refraction_factor(bin_in: Column, bin_out: Column, refraction: Column, params: LightParams = LightParams()) -> Column:
    """exp(-k n (d / bins)^2); 0 without bins."""
    if params.bins == 0:
        return F.lit(0.0)
    x = angular_distance(bin_in, bin_out, params.bins) / F.lit(float(params.bins))
    return F.exp(F.lit(-float(params.k)) * refraction * x * x)


def intensity_to_distance(intensity: Column, eps: float = 1e-6) -> Column:
    x = intensity + F.lit(float(eps))
    return F.when(x > 0, -F.log(x)).otherwise(F.lit(float("inf")))


def strongest_first(x: Column) -> Column:
    """Descending order of sums of doubles: equal to nine places is a tie, whatever order the parts were added in."""
    return F.round(x, 9).desc()


def directional_luminance(prop: Column, peak: Column, falloff: Column) -> Column:
    """peak max(0, 1 - d / 16 falloff) for each bin at distance d from the property's."""
    at = property_bin(prop)
    return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: peak * F.greatest(F.lit(0.0), F.lit(1.0) - angular_distance(at, b) / F.lit(float(BINS)) * falloff))


def uniform_luminance(luminance: Column) -> Column:
    return F.array_repeat(luminance, BINS)


def primary_luminance(bin_: Column, luminance: Column, spread: Column) -> Column:
    """`spread` in every bin but the primary one, which has `luminance`."""
    return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.when(b == F.pmod(bin_, F.lit(BINS)), luminance).otherwise(spread))


def effective_luminance(prop: Column, directional: Column, luminance: Column) -> Column:
    return F.when(prop.isNotNull(), F.array_max(directional)).otherwise(luminance)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine; 0 if either norm is tiny."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((na > TINY) & (nb > TINY), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def l2_normalize(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(TINY))
    return F.transform(v, lambda x: x.cast("double") / n)


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def content_id(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 12)


# The named entities that occur in practice; numeric ones are decoded by rule. The source's html text
# uses the library's full table, as does sources.documents.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags out, common entities decoded, white space collapsed. JVM only."""
    spoken = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", "")
    x = F.regexp_replace(spoken, "<[^>]+>", " ")
    for entity, char in ENTITIES.items():
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = F.replace(x, F.lit("&amp;"), F.lit("&"))  # last, so that no entity is decoded twice
    return F.trim(F.regexp_replace(x, r"[\s ]+", " "))


def byte_at(bits: Column, at: Column) -> Column:
    """A byte of a bitmap as a number, counted from 0."""
    return F.conv(F.hex(F.substring(bits, at.cast("int") + 1, F.lit(1))), 16, 10).cast("int")


def bit_at(bits: Column, at: Column) -> Column:
    """A bit of a bitmap, counted from 0, the lowest of a byte first."""
    return F.getbit(byte_at(bits, F.floor(at / 8)), (at % 8).cast("int"))
