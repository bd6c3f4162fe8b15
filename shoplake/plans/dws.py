"""Summary layer. Sums only; ratios are formed from them later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplake.functions.scalars import cents_of, from_cents, line_net, sum_money
from shoplake.operators.joins import orders_with_user


def _happened(column: str) -> Column:
    return F.col(column).isNotNull()


def _paid_amount() -> Column:
    paid = F.when(_happened("pay_time"), F.col("total_amount"))
    return F.coalesce(sum_money(paid), F.lit(0).cast("decimal(22,2)"))


def trade_user_day(acc: DataFrame) -> DataFrame:
    return acc.groupBy("user_id", "dt").agg(
        F.count(F.lit(1)).alias("order_cnt"), sum_money("total_amount").alias("order_amt"),
        F.count("pay_time").alias("paid_cnt"), _paid_amount().alias("paid_amt"),
        F.count("shipping_time").alias("shipped_cnt"), F.count("complete_time").alias("completed_cnt"),
        F.count("cancel_time").alias("cancelled_cnt"), sum_money("discount_amount").alias("discount_amt"))


def _line_sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("line_cnt"), F.sum("quantity").alias("qty"),
            sum_money("subtotal").alias("gross_amt"), sum_money("discount_amount").alias("discount_amt"),
            sum_money("net_amount").alias("net_amt"),
            sum_money("current_price_amount").alias("current_price_amt")]


def trade_product_day(items: DataFrame) -> DataFrame:
    return items.groupBy("product_id", "dt").agg(*_line_sums())


def product_day_from_lines(items: DataFrame, products: DataFrame) -> DataFrame:
    """`trade_product_day` from lines without product columns.

    Lines are summed first, map-side, so a product with many of them never meets in one
    task; its price today is looked up for the sums.
    """
    sums = items.groupBy("product_id", F.to_date("create_time").alias("dt")).agg(
        F.count(F.lit(1)).alias("line_cnt"), F.sum("quantity").alias("qty"),
        sum_money("subtotal").alias("gross_amt"), sum_money("discount_amount").alias("discount_amt"),
        sum_money(line_net("subtotal", "discount_amount")).alias("net_amt"))
    today = products.select("product_id", cents_of("price").alias("_cents"))
    return sums.join(today, "product_id", "left").select(
        *sums.columns, from_cents(F.col("_cents") * F.col("qty"), "decimal(22,2)").alias("current_price_amt"))


def category_day_sums(items: DataFrame) -> DataFrame:
    """Sums per category and day: one row per group leaves a task, however many lines it read."""
    return items.groupBy("category", "dt").agg(*_line_sums())


def trade_category_day(items: DataFrame) -> DataFrame:
    """From lines, since distinct orders of products do not add up to a category's.

    Only the narrow (category, day, order) rows of the order count cross the network by order.
    """
    orders = (items.select("category", "dt", "order_id").distinct()
              .groupBy(F.col("category").alias("_category"), F.col("dt").alias("_dt"))
              .agg(F.count(F.lit(1)).alias("order_cnt")))
    sums = category_day_sums(items)
    same = F.col("category").eqNullSafe(F.col("_category")) & F.col("dt").eqNullSafe(F.col("_dt"))
    return sums.join(orders, same).select(*sums.columns, "order_cnt")


def trade_province_day(user_day: DataFrame, users: DataFrame) -> DataFrame:
    """By the buyer's province. A user-day row is one buyer, so nothing is de-duplicated."""
    placed = orders_with_user(user_day, users, ["province"])
    return placed.groupBy("province", "dt").agg(
        F.count(F.lit(1)).alias("buyer_cnt"), F.sum("order_cnt").alias("order_cnt"),
        F.sum("order_amt").alias("order_amt"), F.sum("paid_amt").alias("paid_amt"))


def user_lifetime(acc: DataFrame) -> DataFrame:
    return acc.groupBy("user_id").agg(
        F.min("order_time").alias("first_order_time"), F.max("order_time").alias("last_order_time"),
        F.count(F.lit(1)).alias("order_cnt"), F.count("pay_time").alias("paid_cnt"),
        _paid_amount().alias("paid_amt"), F.count("cancel_time").alias("cancelled_cnt"))


def product_stock_day(per_day: DataFrame) -> DataFrame:
    return per_day.select("product_id", "dt", F.col("day_end_stock").alias("stock"), "out_qty",
                          F.when(F.col("day_end_stock") <= 0, 1).otherwise(0).alias("stockout"))
