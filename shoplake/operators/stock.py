"""Stock: deductions with a floor, running levels, day-end snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplake.operators.ordered import ordered_scan


def floored_levels(changes: DataFrame, opening: str, delta: str, key: str, order: list[str],
                   name: str = "level", pieces: int | None = None) -> DataFrame:
    """Level after each change when it can never fall below zero.

    With S the unclipped running level, the clipped one is S plus the largest amount
    by which S has been below zero so far. Exact for any mix of signs.
    """
    summed = ordered_scan(changes, [key], order, running={"_sum": delta}, pieces=pieces,
                          keep_segment=True)
    raw = F.col(opening) + F.col("_sum")
    short = summed.withColumn("_raw", raw).withColumn("_short", -F.col("_raw"))
    seen = ordered_scan(short, [key], order, peak_before={"_worst": "_short"}, presplit=True)
    lift = F.greatest(F.lit(0), F.col("_short"), F.coalesce("_worst", F.lit(0)))
    return seen.withColumn(name, (F.col("_raw") + lift).cast("int")).drop("_sum", "_raw", "_short", "_worst")


def deduct_stock(products: DataFrame, lines: DataFrame, pieces: int | None = None
                 ) -> tuple[DataFrame, DataFrame]:
    """Take ordered pieces out of stock, never below zero.

    `lines` has product_id, order_id, order_time, quantity. Returns the products and
    one ORDER_DEDUCT row per (order, product): delta is the full quantity, stock_after
    the floored level. A product that is not listed has no stock.
    """
    taken = lines.groupBy("product_id", "order_id").agg(
        F.sum("quantity").cast("int").alias("_qty"), F.min("order_time").alias("change_time"))
    opened = (taken.join(products.select("product_id", F.col("stock").alias("_open")), "product_id", "left")
              .withColumn("_open", F.coalesce("_open", F.lit(0)))
              .withColumn("delta", -F.col("_qty")))
    levels = ordered_scan(opened, ["product_id"], ["change_time", "order_id"],
                          running={"_out": "_qty"}, pieces=pieces)
    log = levels.select(
        "product_id", "order_id", F.lit("ORDER_DEDUCT").alias("change_type"), "delta",
        F.greatest(F.col("_open") - F.col("_out"), F.lit(0)).cast("int").alias("stock_after"), "change_time")
    sums = taken.groupBy("product_id").agg(F.sum("_qty").alias("_out"), F.max("change_time").alias("_at"))
    left = products.join(sums, "product_id", "left")
    updated = left.withColumns({
        "stock": F.greatest(F.col("stock") - F.coalesce("_out", F.lit(0)), F.lit(0)).cast("int"),
        "update_time": F.coalesce("_at", "update_time")}).select(*products.columns)
    return updated, log


def running_stock(log: DataFrame, pieces: int | None = None) -> DataFrame:
    """Cumulative delta beside the recorded level."""
    return ordered_scan(log, ["product_id"], ["change_time", "change_id"],
                        running={"running_delta": "delta"}, pieces=pieces)


def day_end_levels(log: DataFrame) -> DataFrame:
    """Last level and pieces in and out per product and day with a change."""
    delta = F.col("delta")
    return (log.withColumn("dt", F.to_date("change_time")).groupBy("product_id", "dt")
            .agg(F.max_by("stock_after", F.struct("change_time", "change_id")).alias("last_stock"),
                 F.sum(F.when(delta > 0, delta).otherwise(0)).alias("in_qty"),
                 F.sum(F.when(delta < 0, -delta).otherwise(0)).alias("out_qty")))


def day_span(facts: DataFrame, ts: str) -> tuple[Column, Column]:
    """First and last day of `facts`, as scalars of a plan; null without facts."""
    return (facts.agg(F.min(F.to_date(ts))).scalar(), facts.agg(F.max(F.to_date(ts))).scalar())


def densify(products: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """Every product on every day: each row expands on its own, nothing is joined. No span, no rows."""
    first, last = (F.lit(d).cast("date") for d in (start, end))
    days = F.when(first <= last, F.sequence(first, F.greatest(first, last)))
    return products.select("product_id", F.explode(days).alias("dt"))


def stock_per_day(products: DataFrame, log: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Day-end stock of each product, the last level carried over days without change.

    Without `start` or `end` the days run from the log's first or to its last. Levels from
    before `start` count; a day before any change has no level. Only the changed days meet their
    product; the days between are made from them row by row, and the dense table is not shuffled.
    """
    first, last = day_span(log, "change_time")
    first, last = (F.lit(start).cast("date") if start else first), (F.lit(end).cast("date") if end else last)
    moves = day_end_levels(log.where(F.to_date("change_time") <= last))
    opening = (moves.where(F.col("dt") < first).groupBy("product_id")
               .agg(F.max_by("last_stock", "dt").alias("_opening")))
    # A product has at most one row per day here, so these windows and lists are small for every key.
    by_day = Window.partitionBy("product_id").orderBy("dt")
    carried = by_day.rowsBetween(Window.unboundedPreceding, 0)
    step = F.struct("dt", F.lead("dt").over(by_day).alias("next"), F.last("last_stock", ignorenulls=True).over(carried).alias("level"),
                    "in_qty", "out_qty")
    steps = (moves.where(F.col("dt") >= first).select("product_id", "dt", step.alias("_step")).groupBy("product_id")
             .agg(F.min("dt").alias("_begun"), F.collect_list("_step").alias("_steps")))
    # the days before the first change are a step of their own, without a change
    none = F.lit(None)
    head = F.struct(first.alias("dt"), F.col("_begun").alias("next"), none.cast("int").alias("level"),
                    none.cast("bigint").alias("in_qty"), none.cast("bigint").alias("out_qty"))
    spans = F.concat(F.when(F.col("_begun") == first, F.array()).otherwise(F.array(head)), F.coalesce("_steps", F.array()))
    stepped = (products.select("product_id").where(first <= last).join(steps, "product_id", "left").join(opening, "product_id", "left")
               .select("product_id", "_opening", F.explode(spans).alias("_s")))
    days = F.sequence("_s.dt", F.coalesce(F.date_sub("_s.next", 1), last))
    changed = F.col("dt") == F.col("_s.dt")
    return stepped.select("product_id", "_opening", "_s", F.explode(days).alias("dt")).select(
        "product_id", "dt", F.coalesce("_s.level", "_opening").alias("day_end_stock"),
        *[F.coalesce(F.when(changed, F.col(f"_s.{c}")), F.lit(0)).alias(c) for c in ("in_qty", "out_qty")])


def total_stock_by_day(per_day: DataFrame) -> DataFrame:
    """Stock adds up over products, never over days."""
    return per_day.groupBy("dt").agg(F.sum("day_end_stock").alias("stock"))
