"""Helpers shared by the text operators of this subpackage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step inside a task holds at a time.
CHUNK_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut Arrow batches into slices of about ``limit`` characters of column ``text``; a longer text stands alone.

    Yields each slice with its texts as a list; null texts are empty strings.
    """
    for batch in batches:
        texts = [x or "" for x in batch.column(text).to_pylist()]
        start, held = 0, 0
        for i, value in enumerate(texts):
            held += len(value)
            if held >= limit:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def per_row(df: DataFrame, column: str, keep: list[str], fields: str, one: Callable) -> DataFrame:
    """Append the fields that ``one(value)`` returns as a tuple to the columns ``keep``; null values arrive as ``""``.

    ``fields`` is a DDL string for the new columns. Runs as one ``mapInArrow`` without a shuffle.
    """
    names = [*keep, column]
    source = df.select(*dict.fromkeys(names))
    ddl = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep), fields])
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        for batch, texts in chunks(batches, column):
            made = [one(x) for x in texts]
            columns = [batch.column(c).cast(schema.field(c).type) for c in keep]
            for k in range(len(keep), len(schema)):
                columns.append(pa.array([m[k - len(keep)] for m in made], type=schema.field(k).type))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return source.mapInArrow(run, ddl)
