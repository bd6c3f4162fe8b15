"""Detail layer: conformed dimensions and shaped facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplake.functions.scalars import date_parts, line_net, line_subtotal, margin, price_band
from shoplake.operators.changes import with_init_rows
from shoplake.operators.history import build_scd2
from shoplake.operators.joins import first_order, lookup_join
from shoplake.operators.status import with_durations
from shoplake.operators.stock import stock_per_day
from shoplake.sources.calendar import calendar


def with_date_parts(days: DataFrame) -> DataFrame:
    """Calendar columns for rows with a `date_key`."""
    return days.select("date_key", *[c.alias(n) for n, c in date_parts("date_key").items()])


def dim_date(spark: SparkSession, start: str, end: str) -> DataFrame:
    return with_date_parts(calendar(spark, start, end))


def dim_user(users: DataFrame, orders: DataFrame) -> DataFrame:
    return first_order(users, orders)


def dim_product(products: DataFrame) -> DataFrame:
    return products.withColumns({
        "price_band": price_band("price"),
        "unit_margin": (F.col("price") - F.col("cost_price")).cast("decimal(11,2)")})


def dim_product_price_scd2(log: DataFrame, products: DataFrame, start: str,
                           pieces: int | None = None) -> DataFrame:
    """Price versions of every product, closed from `start` by an opening version."""
    return build_scd2(with_init_rows(log, products, start), pieces=pieces)


def fact_order_item(items: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with category, brand, net amount, current price and margin; no line is lost."""
    looked = lookup_join(items, products, ["category", "brand", "price", "cost_price"])
    return (looked.withColumnRenamed("price", "current_price")
            .withColumn("net_amount", line_net("subtotal", "discount_amount"))
            .withColumn("current_price_amount", line_subtotal("quantity", "current_price"))
            .withColumn("gross_margin", margin("net_amount", "quantity", "cost_price"))
            .withColumn("dt", F.to_date("create_time")))


def fact_order_acc(orders: DataFrame) -> DataFrame:
    """One row per order: four milestones and three durations. Deleted orders count."""
    kept = ["order_id", "user_id", "order_status", "item_count", "total_amount", "discount_amount",
            "order_time", "pay_time", "shipping_time", "complete_time", "cancel_time", "is_deleted"]
    return with_durations(orders.select(*kept)).withColumn("dt", F.to_date("order_time"))


def fact_product_stock_per_day(products: DataFrame, log: DataFrame, start: str | None = None,
                               end: str | None = None) -> DataFrame:
    return stock_per_day(products, log, start, end)
