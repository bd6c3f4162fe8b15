"""Checks that return their findings as tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplake.functions.scalars import ratio
from shoplake.model import CANCELLED, COMPLETED, PAID, SHIPPED
from shoplake.operators.aggregates import order_totals, throughput
from shoplake.operators.changes import out_of_order
from shoplake.operators.history import price_at, scd2_join
from shoplake.operators.joins import orphans
from shoplake.operators.ordered import ordered_scan
from shoplake.operators.sets import missing_keys
from shoplake.operators.stock import running_stock


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def header_vs_lines(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose header differs from the sum of their lines (pieces, amount, discount)."""
    lines = order_totals(items).select(
        "order_id", F.col("item_count").alias("_pieces"), F.col("total_amount").alias("_amount"),
        F.col("discount_amount").alias("_discount"))
    both = orders.select("order_id", "item_count", "total_amount", "discount_amount") \
        .join(lines, "order_id")
    gaps = both.select(
        "order_id", (F.col("item_count") - F.col("_pieces")).alias("count_gap"),
        (F.col("total_amount") - F.col("_amount")).alias("amount_gap"),
        (F.col("discount_amount") - F.col("_discount")).alias("discount_gap"))
    return gaps.where((F.col("count_gap") != 0) | (F.col("amount_gap") != 0) | (F.col("discount_gap") != 0))


def line_arithmetic(items: DataFrame) -> DataFrame:
    """Lines whose subtotal is not pieces x unit price."""
    want = F.col("quantity").cast("decimal(10,0)") * F.col("unit_price")
    return items.withColumn("gap", (F.col("subtotal") - want).cast("decimal(14,2)")).where(F.col("gap") != 0)


def orphans_both_ways(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Lines without an order and orders without a line."""
    lost = orphans(items, orders, "order_id").select(
        F.lit("line_without_order").alias("finding"), F.col("item_id").alias("id"))
    empty = orphans(orders, items, "order_id").select(
        F.lit("order_without_line").alias("finding"), F.col("order_id").alias("id"))
    return lost.unionByName(empty)


def time_not_increasing(log: DataFrame, pieces: int | None = None) -> DataFrame:
    return out_of_order(log, pieces=pieces)


def replay_completeness(expected: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """How many changes should be, were, and were not processed."""
    missing = missing_keys(expected, processed, key).agg(F.count(F.lit(1))).scalar()
    done = processed.agg(F.count_distinct(key)).scalar()
    return (expected.agg(F.count_distinct(key).alias("expected"))
            .select("expected", done.alias("processed"), missing.alias("missing"))
            .withColumn("complete", F.when(F.col("missing") == 0, 1).otherwise(0)))


def milestone_order(orders: DataFrame) -> DataFrame:
    """Orders with milestones out of order, or inconsistent with their status."""
    def after(a: str, b: str) -> Column:
        return F.coalesce(F.col(b) < F.col(a), F.lit(False))

    def flag(test: Column) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), 1).otherwise(0)

    s = F.col("order_status")
    need = {"pay_time": [PAID, SHIPPED, COMPLETED], "shipping_time": [SHIPPED, COMPLETED],
            "complete_time": [COMPLETED], "cancel_time": [CANCELLED]}
    mismatch = F.lit(False)
    for column, statuses in need.items():
        have = F.col(column).isNotNull()
        wanted = s.isin(*statuses)
        if column == "pay_time":
            # A cancelled order may have been paid before.
            mismatch = mismatch | (wanted & ~have) | (have & ~wanted & (s != CANCELLED))
        else:
            mismatch = mismatch | (wanted != have)
    checked = orders.select(
        "order_id", "order_status",
        flag(after("order_time", "pay_time") | after("pay_time", "shipping_time")
             | after("shipping_time", "complete_time") | after("order_time", "cancel_time")).alias("not_in_order"),
        flag(mismatch).alias("status_mismatch"))
    return checked.where((F.col("not_in_order") == 1) | (F.col("status_mismatch") == 1))


def version_coverage(items: DataFrame, scd2: DataFrame, pieces: int | None = None) -> DataFrame:
    """Share of lines that find a price version."""
    hit = scd2_join(items, scd2, pieces=pieces)
    found = F.count("version_no")
    return hit.agg(F.count(F.lit(1)).alias("lines"), found.alias("matched"),
                   ratio(found, F.count(F.lit(1))).alias("coverage"))


def price_chain_breaks(log: DataFrame, pieces: int | None = None) -> DataFrame:
    """Changes whose old price is not the price left by the change before."""
    seen = ordered_scan(log, ["product_id"], ["change_time", "change_id"],
                        previous={"prev_price": "new_price", "_prev_id": "change_id"}, pieces=pieces)
    return seen.where(F.col("_prev_id").isNotNull()
                      & ~F.col("old_price").eqNullSafe(F.col("prev_price"))).drop("_prev_id")


def scd2_breaks(scd2: DataFrame, key: str = "product_id", start: str = "price_start_time",
                end: str = "price_end_time", pieces: int | None = None) -> DataFrame:
    """Keys with gaps, overlaps, or not exactly one current version."""
    seen = ordered_scan(scd2, [key], [start], following={"_next": start}, pieces=pieces)
    until = F.col(end)
    flags = seen.groupBy(key).agg(
        F.count_if(F.col("_next").isNotNull() & (until < F.col("_next"))).alias("gaps"),
        F.count_if(F.col("_next").isNotNull() & (until.isNull() | (until > F.col("_next")))).alias("overlaps"),
        F.count_if(F.col("is_current") == 1).alias("current_rows"))
    return flags.where((F.col("gaps") > 0) | (F.col("overlaps") > 0) | (F.col("current_rows") != 1))


def unit_price_mismatch(items: DataFrame, log: DataFrame, products: DataFrame,
                        granularity: str = "second", pieces: int | None = None) -> DataFrame:
    """Lines whose stored unit price is not the price in force then."""
    priced = price_at(items, log, products, granularity=granularity, pieces=pieces)
    return priced.where(~F.col("unit_price").eqNullSafe(F.col("asof_price")))


def current_price_mismatch(products: DataFrame, log: DataFrame) -> DataFrame:
    """Products whose price is not the last logged price."""
    last = log.groupBy("product_id").agg(
        F.max_by("new_price", F.struct("change_time", "change_id")).alias("last_price"))
    return (products.select("product_id", "price").join(last, "product_id")
            .where(~F.col("price").eqNullSafe(F.col("last_price"))))


def stock_gap(log: DataFrame, pieces: int | None = None) -> DataFrame:
    """Per product: last recorded level against the sum of deltas.

    Recorded levels are clipped at zero and deltas are not, so a gap is a finding to
    look at, not always an error.
    """
    last = log.groupBy("product_id").agg(
        F.max_by("stock_after", F.struct("change_time", "change_id")).alias("last_stock"),
        F.sum("delta").alias("sum_delta"))
    return last.withColumn("gap", F.col("last_stock") - F.col("sum_delta")).where(F.col("gap") != 0)


def outside_domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Values outside a domain, with their counts."""
    return (df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed))
            .groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(column).alias("column_name"), "value", "rows"))


def below_floor(df: DataFrame, key: str, column: str, floor: str) -> DataFrame:
    limit = F.lit(floor).cast(df.schema[column].dataType)
    return df.where(F.col(column) < limit).select(key, F.col(column).alias("value"))


def city_outside_province(users: DataFrame, places: Mapping[str, list[str]] | DataFrame) -> DataFrame:
    """Users whose city does not belong to their province.

    `places` is a mapping or a frame (province, city) with one row per city; the list
    of cities is a fixed small table, so it is broadcast.
    """
    if isinstance(places, DataFrame):
        known = places
    else:
        rows = [(p, c) for p, cities in places.items() for c in cities]
        known = users.sparkSession.createDataFrame(rows, "province string, city string")
    placed = users.where(F.col("city").isNotNull())
    return placed.join(F.broadcast(known.select("province", "city").distinct()),
                       ["province", "city"], "left_anti")


def caliber_drift(orders: DataFrame) -> DataFrame:
    """Cancel rate over all rows and over rows left after physical removal, in one pass."""
    cancelled = F.col("order_status") == CANCELLED
    alive = F.col("is_deleted") == 0
    sums = orders.agg(F.count(F.lit(1)).alias("all_orders"), F.count_if(cancelled).alias("all_cancelled"),
                      F.count_if(alive).alias("kept_orders"),
                      F.count_if(cancelled & alive).alias("kept_cancelled"))
    return sums.select("*", ratio("all_cancelled", "all_orders").alias("cancel_rate"),
                       ratio("kept_cancelled", "kept_orders").alias("cancel_rate_after_removal"))


def rate_check(probes: DataFrame, target_rate: float, tolerance: float = 0.05) -> DataFrame:
    return throughput(probes, target_rate, tolerance)


def update_time_regressions(log: DataFrame, key: str, seq: str, time: str = "update_time",
                            pieces: int | None = None) -> DataFrame:
    """Rows whose update time is before that of the key's previous row in source order."""
    seen = ordered_scan(log, [key], [seq], previous={"prev_time": time}, pieces=pieces)
    return seen.where(F.col(time) < F.col("prev_time"))


def grid_coverage(mart: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of a mart against the full grid of its two keys."""
    counts = mart.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(a).alias("keys_a"),
                      F.count_distinct(b).alias("keys_b"))
    full = F.col("keys_a") * F.col("keys_b")
    return counts.withColumn("missing", full - F.col("rows")).withColumn(
        "complete", F.when(F.col("missing") == 0, 1).otherwise(0))


def stock_trail(log: DataFrame, pieces: int | None = None) -> DataFrame:
    """Each recorded level beside the running delta, for reading a gap row by row."""
    return running_stock(log, pieces)
