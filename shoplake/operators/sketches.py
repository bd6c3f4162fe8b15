"""Sketches that merge: distinct counts and quantiles kept per day or id range, united for any span.

A row of sketches is small and fixed in size, so a month is the union of its days and no
raw row is read again. Estimates have a stated error; below the sketch's size, distinct
counts are exact.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_ENTRIES = 14                 # a theta sketch keeps 2^14 hashes: a standard error of 0.8 %
KLL_SIZE = 400                  # of a quantile sketch: a rank error of about 0.7 %
RANK_ERROR = 0.02               # that a merged quantile keeps with a wide margin


def distinct_sketches(df: DataFrame, by: list[str], key: str, name: str = "keys") -> DataFrame:
    """One sketch of the distinct `key` values per group; nulls count as nothing."""
    return df.groupBy(*by).agg(F.theta_sketch_agg(key, LG_ENTRIES).alias(name))


def united(sketches: DataFrame, by: Mapping[str, Column], name: str = "keys") -> DataFrame:
    """Sketches of wider groups, from those of narrower ones."""
    return sketches.groupBy(*[c.alias(n) for n, c in by.items()]).agg(F.theta_union_agg(name, LG_ENTRIES).alias(name))


def estimate(sketch: str | Column) -> Column:
    return F.theta_sketch_estimate(sketch)


def in_both(left: str | Column, right: str | Column) -> Column:
    """About how many values two sketches share. The error is that of the larger, so a small share of it is uncertain."""
    return F.theta_sketch_estimate(F.theta_intersection(left, right))


def distinct_error(count: Column) -> Column:
    """Three standard errors of a count."""
    return F.when(count <= 1 << LG_ENTRIES, 0.0).otherwise(3 * count / F.lit(float(1 << LG_ENTRIES)) ** 0.5)


def quantile_sketches(df: DataFrame, by: list[str], value: str, name: str = "values") -> DataFrame:
    """One quantile sketch of a whole-number column per group."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_bigint(value, KLL_SIZE).alias(name), F.count(value).alias("n"))


def merged_quantiles(sketches: DataFrame, by: Mapping[str, Column], probs: Mapping[str, float], name: str = "values") -> DataFrame:
    """Quantiles of wider groups, from the sketches of narrower ones."""
    merged = sketches.groupBy(*[c.alias(n) for n, c in by.items()]).agg(
        F.kll_merge_agg_bigint(name).alias(name), F.sum("n").alias("n"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_bigint(name, F.lit(float(p))).alias(c) for c, p in probs.items()])
