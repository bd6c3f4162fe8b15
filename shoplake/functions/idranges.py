"""Id ranges such as `1,5,10-20,100-`: parsed once, used as a predicate or as rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplake.operators.ordered import ordered_scan

OPEN_END = 2 ** 63 - 1      # the largest id there is


class RangeSyntaxError(ValueError):
    """The range text is not valid; a bad filter must never be ignored."""


def parse_ranges(text: str | None) -> list[tuple[int, int]]:
    """Text -> sorted disjoint inclusive ranges. Empty text means no filter: []."""
    found = []
    for part in (p.strip() for p in (text or "").split(",")):
        if not part:
            continue
        shape = re.fullmatch(r"(\d*)\s*-\s*(\d*)|(\d+)", part)
        if not shape:
            raise RangeSyntaxError(f"not an id or id range: {part!r}")
        if shape[3]:
            low = high = int(shape[3])
            if low < 1:
                raise RangeSyntaxError(f"ids start at 1: {part!r}")
        else:
            low = int(shape[1]) if shape[1] else 1
            high = int(shape[2]) if shape[2] else OPEN_END
        if low > high:
            raise RangeSyntaxError(f"lower bound above upper bound: {part!r}")
        found.append((low, high))
    merged: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(merged[-1][1], high))
        else:
            merged.append((low, high))
    return merged


def id_range_filter(text: str | None, column: str | Column) -> Column:
    """Predicate for a range text; pushed to the scan as plain comparisons."""
    at = F.col(column) if isinstance(column, str) else column
    test = None
    for low, high in parse_ranges(text):
        if low == high:
            one = at == low
        elif high == OPEN_END:
            one = at >= low
        else:
            one = at.between(low, high)
        test = one if test is None else test | one
    return F.lit(True) if test is None else test


def ranges_frame(spark: SparkSession, text: str | None) -> DataFrame:
    """The parsed ranges as rows (lo, hi)."""
    return spark.createDataFrame(parse_ranges(text), "lo long, hi long")


def merge_intervals(df: DataFrame, lo: str = "lo", hi: str = "hi", by: tuple[str, ...] = (),
                    pieces: int | None = None) -> DataFrame:
    """Join overlapping or adjacent inclusive ranges per `by`."""
    keys = list(by)
    spans = df.select(*keys, lo, hi).distinct()
    seen = ordered_scan(spans, keys, [lo, hi], peak_before={"_reach": hi}, pieces=pieces,
                        keep_segment=True)
    opens = F.when(F.col("_reach").isNull() | (F.col(lo) > F.col("_reach")) & (F.col(lo) - 1 > F.col("_reach")), 1).otherwise(0)
    islands = ordered_scan(seen.withColumn("_opens", opens), keys, [lo, hi],
                           running={"_island": "_opens"}, presplit=True)
    return (islands.groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi))
            .drop("_island"))


def in_ranges(df: DataFrame, ranges: DataFrame, key: str, lo: str = "lo", hi: str = "hi",
              pieces: int | None = None) -> DataFrame:
    """Rows whose key lies in any range row, for range lists of any length.

    Ranges are merged first; then the last range starting at or before each key is
    carried to it, so no key is compared with more than one range.
    """
    starts = merge_intervals(ranges.select(F.col(lo).alias("_lo"), F.col(hi).alias("_hi")),
                             "_lo", "_hi", pieces=pieces)
    keys = df.select(F.col(key).alias("_at")).distinct()
    points = keys.select("_at", F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_hi"))
    marks = starts.select(F.col("_lo").cast(df.schema[key].dataType).alias("_at"),
                          F.lit(0).alias("_side"), "_hi")
    covered = (ordered_scan(points.unionByName(marks), [], ["_at", "_side"],
                            filled={"_until": "_hi"}, pieces=pieces)
               .where((F.col("_side") == 1) & (F.col("_at") <= F.col("_until"))))
    return df.join(covered.select(F.col("_at").alias(key)), key, "left_semi").select(*df.columns)


def range_size(ranges: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Ids covered by disjoint ranges, as an exact decimal; an open range ends at OPEN_END."""
    size = F.col(hi).cast("decimal(20,0)") - F.col(lo).cast("decimal(20,0)") + 1
    return ranges.agg(F.coalesce(F.sum(size), F.lit(0)).cast("decimal(38,0)").alias("ids"))
