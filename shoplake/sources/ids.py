"""Contiguous ids and key-range splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplake.operators.ordered import ordered_scan


def assign_ids(df: DataFrame, order: list[str], name: str, after: DataFrame | None = None,
               after_key: str | None = None, pieces: int | None = None) -> DataFrame:
    """Number rows in `order`, continuing after the largest id of `after` (0 if empty).

    `order` must be unique, so that a recomputed task gives the same ids.
    """
    numbered = ordered_scan(df, [], order, number="_nr", pieces=pieces)
    start = F.lit(0)
    if after is not None:
        start = after.agg(F.coalesce(F.max(after_key or name), F.lit(0))).scalar()
    return numbered.withColumn(name, (F.col("_nr") + start).cast("bigint")).drop("_nr")


def split_ranges(spark: SparkSession, total: int, shards: int) -> DataFrame:
    """[0, total) in equal [start, end) rows; no empty shard."""
    per = -(-total // shards) if total else 1
    return (spark.range(shards).select(F.col("id").alias("shard"), (F.col("id") * per).alias("start"))
            .where(F.col("start") < total)
            .withColumn("end", F.least(F.col("start") + per, F.lit(total))))
