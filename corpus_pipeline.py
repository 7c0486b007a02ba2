"""A training corpus from raw documents: language, quality, near copies, personal data, packing.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir), works on all that the
stage before it kept, and returns a DataFrame. All but the last return the columns of documents.
run() writes what each returns as Parquet in the shared folder and hands the next one the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lightgraph.llm import langid, packing, pii, quality, simhash
from lightgraph.session import materialize, prepare, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with one that is told too weakly, go."""
    prepare(spark)
    return langid.keep(docs, langid.fit(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below a half go."""
    prepare(spark)
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    prepare(spark)
    return simhash.first_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; n_chars follows."""
    prepare(spark)
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in training sequences."""
    prepare(spark)
    return packing.sequences(docs)


STAGES = [
    ("language ID", language),
    ("quality classifier", good_quality),
    ("SimHash near-dedup", near_copies),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: Learned models and token ids are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, from the documents of sf_dir."""
    docs = table(prepare(spark), sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
