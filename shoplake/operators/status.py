"""Order life cycle: transitions, traces, the accumulating snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplake.functions.idranges import id_range_filter
from shoplake.functions.scalars import seconds_between
from shoplake.model import CANCELLED, COMPLETED, CREATED, PAID, SHIPPED, STATUS_STEPS
from shoplake.operators.ordered import ordered_scan

MILESTONES = {PAID: "pay_time", SHIPPED: "shipping_time",
              COMPLETED: "complete_time", CANCELLED: "cancel_time"}


def is_valid_step(old: Column, new: Column) -> Column:
    """A listed step, or CREATED as the first status."""
    steps = [f"{a}>{b}" for a, b in STATUS_STEPS]
    return F.when(old.isNull(), new == CREATED).otherwise(F.concat(old, F.lit(">"), new).isin(*steps))


def transitions(log: DataFrame, key: str = "order_id", seq: str = "seq",
                pieces: int | None = None) -> DataFrame:
    """(from, to, valid) for every row of a status log."""
    seen = ordered_scan(log, [key], [seq], previous={"from_status": "status"}, pieces=pieces)
    return seen.withColumnRenamed("status", "to_status").withColumn(
        "valid", F.when(is_valid_step(F.col("from_status"), F.col("to_status")), 1).otherwise(0))


def order_trace(log: DataFrame, ids: str, key: str = "order_id", seq: str = "seq",
                pieces: int | None = None) -> DataFrame:
    """Numbered status steps of chosen orders, one row per step."""
    chosen = log.where(id_range_filter(ids, key))
    return ordered_scan(chosen, [key], [seq], previous={"from_status": "status"},
                        number="step_no", pieces=pieces)


def milestones(log: DataFrame, key: str = "order_id", ts: str = "ts") -> DataFrame:
    """Earliest time of each status per order; order and repeats do not matter."""
    firsts = [F.min(F.when(F.col("status") == s, F.col(ts))).alias(c)
              for s, c in {CREATED: "order_time", **MILESTONES}.items()]
    return log.groupBy(key).agg(*firsts)


def with_durations(acc: DataFrame) -> DataFrame:
    return acc.withColumns({
        "pay_sec": seconds_between("order_time", "pay_time"),
        "ship_sec": seconds_between("pay_time", "shipping_time"),
        "complete_sec": seconds_between("shipping_time", "complete_time"),
    })


def flag_new_customer(orders: DataFrame) -> DataFrame:
    """1 on the first order of each user (the id breaks ties), else 0."""
    first = (orders.groupBy("user_id")
             .agg(F.min_by("order_id", F.struct("order_time", "order_id")).alias("_first")))
    return (orders.join(first, "user_id", "left")
            .withColumn("is_new_customer", F.when(F.col("order_id") == F.col("_first"), 1).otherwise(0))
            .drop("_first"))
