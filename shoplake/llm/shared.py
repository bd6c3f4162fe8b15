"""Helpers of the text operators: whole tables in, stored intermediate tables, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shoplake.session import scratch_dir

Batches = Iterator[pa.RecordBatch]
SLICE_BYTES = 4 << 20           # text turned into Python objects at a time; a longer text stands alone


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared checkpoint folder and read back: lineage is cut, and a
    lost executor costs a re-read, not a recomputation."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text string): a null text is empty. Other columns, whatever their names, are left out."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def arrow_shape(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def slices(batches: Batches, most: int = SLICE_BYTES) -> Batches:
    """The rows of all batches in order, some `most` bytes of strings and binaries at a time."""
    for batch in batches:
        sizes = np.full(batch.num_rows, 64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        begin, ends = 0, np.cumsum(sizes)
        while begin < batch.num_rows:
            held = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, held + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def map_batches(df: DataFrame, schema: str | StructType, work: Callable[..., dict[str, list]],
                done: Callable[[], None] | None = None) -> DataFrame:
    """Apply `work(**columns as Python lists) -> columns` to the rows, cut by bytes.

    `done` runs after a task's last row, to free what `work` keeps: workers are used again.
    """
    shape = arrow_shape(schema)

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            got = work(**{name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_pydict(got, schema=shape)
        if done:
            done()
        pa.default_memory_pool().release_unused()
    return df.mapInArrow(run, schema)


def runs(many: list[str], chars: int) -> Iterator[list[str]]:
    """Consecutive texts, about `chars` characters at a time; a longer text stands alone."""
    part, held = [], 0
    for t in many:
        if part and held + len(t) > chars:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part
