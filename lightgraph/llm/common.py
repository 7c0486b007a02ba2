"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold(column: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % modulus


def held_out(column: Column | str, modulus: int, remainder: int) -> Column:
    """Whether the id falls in the held-out fold; false for a null id."""
    return F.coalesce(fold(column, modulus) == remainder, F.lit(False))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow where make() sets up once a task and its result turns a batch into column lists or arrays."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, work = to_arrow_schema(kind), None
        for batch in batches:
            if batch.num_rows:
                work = work or make()
                columns = [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) for c, f in zip(work(batch), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, kind)


def filter_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """Keep the rows for which the function says true; every column passes unchanged, whatever its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if batch.num_rows:
                work = work or make()
                yield batch.filter(pa.array(work(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)
