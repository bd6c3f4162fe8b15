"""Two streams joined, and stateful operators in a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplake.streaming.windows import event_time


def orders_with_lines(orders: DataFrame, lines: DataFrame, time: str, within: str, delay: str) -> DataFrame:
    """Lines with their order, either way unmatched ones too, from two streams in any arrival order.

    Both have order_id and the event time `time`; a line belongs to an order sent at most
    `within` before it. Rows wait in the state until the watermark of both streams has
    passed that span; then unmatched ones leave with nulls on the other side. Columns
    of the order are prefixed by `order_`.
    """
    left = event_time(orders, time).withWatermark(time, delay).select(
        *[F.col(c).alias(c if c.startswith("order_") else f"order_{c}") for c in orders.columns])
    right = event_time(lines, time).withWatermark(time, delay).withColumnRenamed("order_id", "line_order_id")
    at = F.col(f"order_{time}")
    span = (F.col(time) >= at) & (F.col(time) <= at + F.expr(f"INTERVAL {within}"))
    return left.join(right, (F.col("order_id") == F.col("line_order_id")) & span, "full_outer")


def bursts(stream: DataFrame, ts: str, width: str, trailing: int, factor: float, delay: str) -> DataFrame:
    """(window_start, rows, usual, burst) of each window with rows, once it is complete.

    `usual` is the mean of the windows with rows among the `trailing` ones before; a burst
    has at least `factor` times as many. Two aggregations in a chain: window counts, then
    sliding spans of windows, both closed by the watermark.
    """
    number, unit = width.split()
    counts = event_time(stream, ts).withWatermark(ts, delay).groupBy(F.window(ts, width).alias("own")) \
        .agg(F.count(F.lit(1)).alias("rows"))
    spans = counts.select("own", "rows", F.window(F.window_time("own"), f"{int(number) * (trailing + 1)} {unit}", width).alias("span"))
    mine = F.col("own.end") == F.col("span.end")
    summed = spans.groupBy("span").agg(F.sum(F.when(mine, F.col("rows"))).alias("rows"), F.sum(F.when(~mine, F.col("rows"))).alias("_sum"),
                                       F.count(F.when(~mine, 1)).alias("_n"))
    usual = F.col("_sum") / F.nullif(F.col("_n"), F.lit(0))
    return summed.where("rows is not null").select(
        (F.col("span.end") - F.expr(f"INTERVAL {width}")).alias("window_start"), "rows", usual.alias("usual"),
        F.when(F.col("rows") >= usual * F.lit(float(factor)), 1).otherwise(0).alias("burst"))
