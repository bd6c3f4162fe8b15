"""Counts, profiles, totals and rates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplake.functions.scalars import latency_ms, price_band, ratio, sum_money
from shoplake.operators.ordered import exact_quantiles
from shoplake.operators.sets import union_shards


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_shards(*[t.agg(F.count(F.lit(1)).alias("row_count"))
                          .select(F.lit(name).alias("table_name"), "row_count")
                          for name, t in tables.items()])


NO_STATUS = "(none)"


def status_distribution(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_status").agg(F.count(F.lit(1)).alias("orders"))


def status_distribution_map(orders: DataFrame) -> DataFrame:
    """The distribution as one map of all statuses that occur; a null one is named NO_STATUS."""
    counted = status_distribution(orders)
    named = F.coalesce("order_status", F.lit(NO_STATUS)).alias("order_status")
    pairs = F.sort_array(F.collect_list(F.struct(named, "orders")))
    return counted.agg(F.map_from_entries(pairs).alias("status_distribution"))


def id_bounds(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Lowest and highest key of several tables as one row."""
    rows = union_shards(*[df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
                          .select(F.lit(name).alias("t"), "lo", "hi")
                          for name, (df, key) in tables.items()])
    return rows.agg(*[c for name in tables for c in (
        F.max(F.when(F.col("t") == name, F.col("lo"))).alias(f"{name}_min"),
        F.max(F.when(F.col("t") == name, F.col("hi"))).alias(f"{name}_max"))])


def max_id(df: DataFrame, key: str, name: str = "max_id") -> DataFrame:
    return df.agg(F.coalesce(F.max(key), F.lit(0)).alias(name))


def log_profile(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("changes"),
                   F.count_distinct("product_id").alias("products"),
                   F.min("change_time").alias("first_time"), F.max("change_time").alias("last_time"))


def order_totals(items: DataFrame) -> DataFrame:
    """Pieces, subtotal, discount and net per order."""
    return (items.groupBy("order_id")
            .agg(F.sum("quantity").alias("item_count"), sum_money("subtotal").alias("subtotal"),
                 sum_money("discount_amount").alias("discount_amount"), F.count(F.lit(1)).alias("lines"))
            .withColumn("total_amount", F.col("subtotal") - F.col("discount_amount")))


def latency_stats(probes: DataFrame, range_size: int, pieces: int | None = None) -> DataFrame:
    """P50, P95 and max of sink time less the writer's clock, per id range; exact."""
    timed = probes.select((F.floor(F.col("id") / range_size) * range_size).alias("id_from"),
                          latency_ms("sink_time", "create_time_ms").alias("ms"))
    tops = timed.groupBy("id_from").agg(F.count(F.lit(1)).alias("probes"), F.max("ms").alias("max_ms"))
    middle = exact_quantiles(timed, ["id_from"], "ms", {"p50_ms": 0.5, "p95_ms": 0.95}, pieces)
    return tops.join(middle, "id_from")


def latency_stats_approx(probes: DataFrame, range_size: int, accuracy: int = 10_000) -> DataFrame:
    """One-pass sketch form of `latency_stats`."""
    timed = probes.select((F.floor(F.col("id") / range_size) * range_size).alias("id_from"),
                          latency_ms("sink_time", "create_time_ms").alias("ms"))
    q = F.percentile_approx("ms", [0.5, 0.95], accuracy)
    return (timed.groupBy("id_from").agg(F.count(F.lit(1)).alias("probes"), q.alias("_q"),
                                         F.max("ms").alias("max_ms"))
            .select("id_from", "probes", F.col("_q")[0].alias("p50_ms"),
                    F.col("_q")[1].alias("p95_ms"), "max_ms"))


def throughput(probes: DataFrame, target_rate: float, tolerance: float = 0.05) -> DataFrame:
    """Rows, id range, seconds, rate and deviation from the target of one load run."""
    run = probes.agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"),
                     F.max("id").alias("last_id"),
                     ((F.max("create_time_ms") - F.min("create_time_ms")) / F.lit(1000.0)).alias("wall_sec"))
    rate = F.col("rows") / F.greatest(F.lit(0.001), F.col("wall_sec"))
    off = F.abs(rate - F.lit(float(target_rate))) / F.lit(float(target_rate))
    return run.select("rows", "first_id", "last_id", "wall_sec", F.round(rate, 6).alias("rate"),
                      F.round(off, 6).alias("deviation"),
                      F.when(off > tolerance, 1).otherwise(0).alias("off_target"))


def hour_profile(df: DataFrame, ts: str, tz: str) -> DataFrame:
    """Share of rows per local hour; the zone is explicit."""
    hours = (df.groupBy(F.hour(F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz)).alias("hour"))
             .agg(F.count(F.lit(1)).alias("orders")))
    total = hours.agg(F.sum("orders").alias("_all"))
    return hours.select("hour", "orders", ratio("orders", total.scalar()).alias("share"))


def hierarchy_rollup(df: DataFrame, levels: Mapping[str, Column], measures: Mapping[str, Column]) -> DataFrame:
    """Totals at every level of a hierarchy, widest first; `level` counts the keys kept."""
    keyed = df.withColumns(dict(levels))
    return (keyed.rollup(*levels)
            .agg(F.grouping_id().alias("_g"), *[m.alias(n) for n, m in measures.items()])
            .withColumn("level", F.lit(len(levels)) - F.bit_count("_g")).drop("_g"))


def ratio_of_sums(df: DataFrame, by: list[str], top: str, bottom: str, name: str) -> DataFrame:
    """A non-additive measure, from its additive parts."""
    return df.groupBy(*by).agg(ratio(F.sum(top), F.sum(bottom)).alias(name))


def duration_stats(acc: DataFrame, pieces: int | None = None) -> DataFrame:
    """Average, P50 and P95 of the three stage durations, in seconds."""
    stages = {"pay": "pay_sec", "ship": "ship_sec", "complete": "complete_sec"}
    pairs = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(c).alias("sec")) for s, c in stages.items()])
    long = (acc.select(F.explode(pairs).alias("_p")).select("_p.*").where(F.col("sec").isNotNull()))
    means = long.groupBy("stage").agg(F.count(F.lit(1)).alias("orders"),
                                      ratio(F.sum("sec"), F.count("sec")).alias("avg_sec"))
    middle = exact_quantiles(long, ["stage"], "sec", {"p50_sec": 0.5, "p95_sec": 0.95}, pieces)
    return means.join(middle, "stage")


def price_band_counts(products: DataFrame) -> DataFrame:
    return (products.groupBy(price_band("price").alias("price_band"))
            .agg(F.count(F.lit(1)).alias("products")))
