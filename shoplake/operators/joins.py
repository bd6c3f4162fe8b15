"""Joins. Sides are not hinted unless their size is fixed: adaptive execution
broadcasts a side it has measured and splits skewed partitions otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplake.operators.ordered import ordered_scan
from shoplake.sources.lake import bucket_count


def update_from_aggregate(target: DataFrame, facts: DataFrame, key: str, value: Column,
                          column: str, only_null: bool = True) -> DataFrame:
    """Set `column` from an aggregate over matching facts, by default only where NULL."""
    grouped = facts.groupBy(key).agg(value.alias("_agg"))
    joined = target.join(grouped, key, "left")
    filled = F.coalesce(F.col(column), F.col("_agg")) if only_null else F.coalesce("_agg", column)
    return joined.withColumn(column, filled.cast(target.schema[column].dataType)).select(*target.columns)


def first_order(users: DataFrame, orders: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Back-fill users.first_order_time; all orders count unless statuses are given."""
    counted = orders if statuses is None else orders.where(F.col("order_status").isin(*statuses))
    return update_from_aggregate(users, counted, "user_id", F.min("order_time"), "first_order_time")


def lookup_join(items: DataFrame, products: DataFrame, columns: list[str]) -> DataFrame:
    """Lines with product columns; an unknown product keeps the line, with matched = 0."""
    dim = products.select("product_id", *columns, F.lit(1).alias("matched"))
    return items.join(dim, "product_id", "left").fillna({"matched": 0})


def unmatched_count(looked_up: DataFrame) -> DataFrame:
    return looked_up.agg(F.count(F.lit(1)).alias("lines"),
                         F.count_if(F.col("matched") == 0).alias("unmatched"))


def header_detail(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Lines with their header columns."""
    shared = [c for c in orders.columns if c in items.columns and c != "order_id"]
    head = orders.select(*[F.col(c).alias(f"order_{c}") if c in shared else F.col(c) for c in orders.columns])
    return items.join(head, "order_id")


def semi_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi").select(*df.columns)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent is missing.

    The number of tasks follows the rows. A task holds each parent key of its part once, and child
    rows pass by unsorted, so its memory does not grow with the tables or with a heavy key.
    """
    n = bucket_count(max(child.count(), parent.count()))
    keys = parent.select(key).repartition(n, key).hint("shuffle_hash")
    return child.repartition(n, key).join(keys, key, "left_anti").select(*child.columns)


def orders_with_user(orders: DataFrame, users: DataFrame, columns: list[str]) -> DataFrame:
    return orders.join(users.select("user_id", *columns), "user_id", "left")


def with_date(facts: DataFrame, calendar: DataFrame, ts: str) -> DataFrame:
    """Facts with calendar columns. A calendar has one row per day: broadcast."""
    return facts.withColumn("date_key", F.to_date(ts)).join(F.broadcast(calendar), "date_key", "left")


def price_snapshot_vs_current(items: DataFrame, products: DataFrame) -> DataFrame:
    """Price when ordered beside the price now."""
    now = products.select("product_id", F.col("price").alias("current_price"))
    return items.join(now, "product_id").withColumn(
        "price_diff", F.col("current_price") - F.col("unit_price"))


def anchor_probe(df: DataFrame, anchors: DataFrame, k: int, key: str = "order_id",
                 pieces: int | None = None) -> DataFrame:
    """For each anchor the first k qualifying keys at or above it.

    Keys and anchors are merged in order once. Only the first k keys after an anchor
    can be an answer, so candidates are numbered and looked up by number: no key is
    compared with an anchor it does not answer.
    """
    points = anchors.select(F.col("anchor").cast("bigint").alias("_at")).distinct()
    merged = (df.select(F.col(key).cast("bigint").alias("_at")).distinct()
              .withColumns({"_side": F.lit(1), "_is_key": F.lit(1)})
              .unionByName(points.withColumns({"_side": F.lit(0), "_is_key": F.lit(0)})))
    counted = ordered_scan(merged, [], ["_at", "_side"], running={"_nr": "_is_key"}, pieces=pieces)
    starts = counted.where(F.col("_side") == 0).select(F.col("_at").alias("anchor"), F.col("_nr").alias("_start"))
    wanted = (starts.select("anchor", "_start", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("probe_no"))
              .withColumn("_nr", F.col("_start") + F.col("probe_no")))
    keys = counted.where(F.col("_side") == 1).select("_nr", F.col("_at").alias(key))
    return wanted.join(keys, "_nr").select("anchor", F.col("probe_no").cast("bigint").alias("probe_no"), key)
