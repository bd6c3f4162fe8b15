"""Generated day source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day, both ends included."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return spark.range(1).select(F.explode(days).alias("date_key"))


def calendar_covering(facts: DataFrame, ts: str) -> DataFrame:
    """One row per day from the first to the last fact."""
    span = facts.agg(F.min(F.to_date(ts)).alias("first"), F.max(F.to_date(ts)).alias("last"))
    return span.where(F.col("first").isNotNull()).select(
        F.explode(F.sequence("first", "last")).alias("date_key"))
