"""Triples from CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters in which a header is looked for.
SNIFF = 1024


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(head, relation, tail), trimmed; rows with fewer than three columns or blanks are dropped. The first line is a header if
    the first characters of the file speak of head and tail."""
    first = spark.read.text(path).limit(20).collect()
    start = "\n".join(r.value for r in first)[:SNIFF].lower()
    raw = spark.read.csv(path, schema="head string, relation string, tail string", header="head" in start and "tail" in start, mode="PERMISSIVE", enforceSchema=True)
    return _clean(raw)


def _clean(raw: DataFrame) -> DataFrame:
    names = ("head", "relation", "tail")
    trimmed = raw.select(*(F.trim(c).alias(c) for c in names))
    for c in names:
        trimmed = trimmed.where(F.col(c).isNotNull() & (F.col(c) != ""))
    return trimmed


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(head, relation, tail) from an array of objects (h, subject / r, predicate / t, object are other names) or of lists."""
    items = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("v"))
    of = lambda *keys: F.coalesce(*(F.get_json_object("v", f"$.{k}") for k in keys))
    listed = F.from_json("v", "array<string>")
    as_list = F.trim(F.col("v")).startswith("[")
    pick = lambda i, *keys: F.when(as_list, F.get(listed, i)).otherwise(of(*keys))
    return _clean(items.select(pick(0, "head", "h", "subject").alias("head"), pick(1, "relation", "r", "predicate").alias("relation"), pick(2, "tail", "t", "object").alias("tail")))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """By extension, else JSON if the first character is a bracket."""
    if path.endswith(".csv"):
        return read_csv(spark, path)
    if path.endswith(".json"):
        return read_json(spark, path)
    first = spark.read.text(path).limit(1).collect()
    return read_json(spark, path) if first and first[0].value.lstrip()[:1] == "[" else read_csv(spark, path)
