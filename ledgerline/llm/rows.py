"""How the operators here see a table: whole rows in steps of bounded text.

Columns are taken by name, so extra columns do no harm. A kept column whose name
an operator's own output also has gives way to the output."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.textwords import STEP_BYTES, steps

#: Name that the text has inside a step, whatever the table has besides.
TEXT = "__text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(names: Iterable[str]) -> list[str]:
    return [f"`{n.replace('`', '``')}`" for n in names]


def schema_of(text: str) -> T.StructType:
    """Of 'a bigint, b string'."""
    return T.StructType.fromDDL(text)


def annotate(
    docs: DataFrame,
    outputs: str,
    fill: Callable[[pa.RecordBatch], list],
    keep: Iterable[str] = ("doc_id",),
    text: str = "text",
    most: int = STEP_BYTES,
) -> DataFrame:
    """The kept columns of every row and what `fill` makes of each step's texts.

    `fill` gets a batch whose column TEXT is the text; it returns one array a column."""
    own = schema_of(outputs)
    keep = [k for k in keep if k not in own.names]
    read = docs.select(*quoted(keep), F.col(quoted([text])[0]).cast("string").alias(TEXT))
    schema = T.StructType([*read.schema.fields[:-1], *own.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, TEXT, most):
            yield pa.RecordBatch.from_arrays([*step.columns[:-1], *map(pa.array, fill(step))], names=schema.names)

    return read.mapInArrow(run, schema)


def rows_where(
    docs: DataFrame, good: Callable[[pa.RecordBatch], object], text: str = "text", most: int = STEP_BYTES
) -> DataFrame:
    """The rows that `good` marks, unchanged; it gets the same batches as annotate()'s `fill`."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, text, most):
            seen = pa.RecordBatch.from_arrays([step.column(at)], names=[TEXT])
            yield step.filter(pa.array(good(seen), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def gathered(df: DataFrame, outputs: str, collect: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]]) -> DataFrame:
    """What `collect` makes of each partition: dicts of equally long arrays."""
    schema = schema_of(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in collect(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[n]) for n in schema.names], names=schema.names)

    return df.mapInArrow(run, schema)
