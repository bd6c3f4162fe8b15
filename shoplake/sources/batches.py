"""Folders of numbered batches, kept apart by the run that wrote them.

A stream numbers its batches from 0. If it is started anew with a fresh checkpoint, the
numbers come again, so each run has a folder of its own: `run=<order>-<id>/batch_id=<n>`.
A repeated batch of one run replaces itself; batches of two runs never meet. Runs are
ordered by their first batch.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplake.sources.lake import folders

BatchKey = tuple[str, int]      # label of the run, number of the batch
PLACES = [T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType())]


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a started stream has stored in its checkpoint; a fresh checkpoint has a new one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def label(spark: SparkSession, path: str, run: str) -> str:
    """Label of a run under `path`: the one it has, else the next in order."""
    found = [name.split("=", 1)[1] for name in folders(spark, path) if name.startswith("run=")]
    mine = [name for name in found if name.split("-", 1)[1] == run]
    return mine[0] if mine else f"{1 + max([int(name.split('-', 1)[0]) for name in found], default=0):06d}-{run}"


def write_batch(df: DataFrame, path: str, run: str, batch_id: int, partition: tuple[str, ...] = ()) -> BatchKey:
    """Store a batch, replacing the same batch of the same run only. With `partition`, by
    folder: a heavy folder becomes several files."""
    key = label(df.sparkSession, path, run), batch_id
    if partition:
        df = df.hint("rebalance", *[F.col(c) for c in partition])
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition).parquet(folder(path, key))
    return key


def folder(path: str, key: BatchKey) -> str:
    return f"{path}/run={key[0]}/batch_id={key[1]}"


def finished(spark: SparkSession, path: str) -> list[BatchKey]:
    """Batches that were written to their end, in order."""
    return sorted((run.split("=", 1)[1], int(name.split("=", 1)[1])) for run in folders(spark, path) if run.startswith("run=")
                  for name in folders(spark, f"{path}/{run}", done=True))


def read_batches(spark: SparkSession, path: str, schema: T.StructType, upto: BatchKey | None = None) -> DataFrame:
    """Rows of all batches (up to one of them, in order), with `run` and `batch_id`."""
    rows = spark.read.schema(T.StructType([*schema.fields, *PLACES])).parquet(path)
    if upto is None:
        return rows
    return rows.where((F.col("run") < upto[0]) | (F.col("run") == upto[0]) & (F.col("batch_id") <= upto[1]))


def append_changes(df: DataFrame, path: str, batch_id: int, run: str = "direct") -> None:
    """Append one batch of a change table. The same batch of the same run written twice counts once."""
    write_batch(df, path, run, batch_id)
