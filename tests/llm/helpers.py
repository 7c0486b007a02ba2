"""Small tables for the operators' corner cases, and plain versions of the contracts."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns whose names operators make themselves.
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, fp long, uid long, held_out boolean, row string"
ODD_TEXTS = [
    None, "", "   \n\t ", "a", "A b", "A b c", "...!!! 123", "ÀÉ été", "x" * 70_000, "word " * 12_000, "a@b.co and +49 151 2345678 and 10.0.0.1 and 4111 1111 1111 1111",
    "the cat sat on the mat " * 3, "line\nline\nline\n", "<|endoftext|>text<|endoftext|>", "​﻿", "\U0001f600" * 9000, "中文字" * 12_000,
]


def odd_rows():
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None, 0.5, 1, 2, 3, True, "r") for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id here at all", None, None, None, None, None, None, None, None, None)]
    rows += [rows[5], rows[5], (77, ODD_TEXTS[9], "de", "s", 4, 0.1, 1, 1, 1, False, "r")]
    return rows


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def words(text):
    return WORD.findall(text or "")


def fold(doc_id, modulus):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
