"""Set operations between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_shards(*shards: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, shards)


def any_of(*conditions: Column) -> Column:
    """Union of filters."""
    return reduce(lambda a, b: a | b, conditions)


def missing_keys(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys that should be there and are not."""
    return expected.select(key).distinct().join(actual.select(key), key, "left_anti")


def diff_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one table and not the other, with how many copies; `side` says where.

    One pass: both sides are counted in a single aggregate over the union.
    """
    columns = a.columns
    both = a.withColumn("_n", F.lit(1)).unionByName(b.select(*columns).withColumn("_n", F.lit(-1)))
    net = both.groupBy(*columns).agg(F.sum("_n").alias("_net")).where(F.col("_net") != 0)
    return net.select(*columns, F.when(F.col("_net") > 0, "left").otherwise("right").alias("side"),
                      F.abs("_net").alias("copies"))
