"""Stored sketches merged for wider spans, held against exact results."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplake.functions.scalars import latency_ms
from shoplake.operators import sketches as S
from shoplake.registry.base import query
from shoplake.registry.model_sql import using
from shoplake.session import scratch_dir
from shoplake.sources import driver_tables as src
from shoplake.sources.lake import load_table


def buyer_days(spark, sf):
    """Sketches of the buyers of each day, stored."""
    path = scratch_dir(spark, "buyer-days")
    orders = src.orders(spark, sf).withColumn("dt", F.to_date("order_time"))
    load_table(S.distinct_sketches(orders, ["dt"], "user_id"), path)
    return spark.read.parquet(path)


def near(guess, exact):
    return F.when(F.abs(guess - exact) <= S.distinct_error(exact) + 0.5, 1).otherwise(0)


@query("buyers_by_month", using("f_orders") + """
SELECT date_trunc('month', dt) AS month, count(DISTINCT user_id) AS buyers, 1 AS near FROM f_orders GROUP BY 1""",
       day="month", whole="near")
def _(spark, sf):
    """Buyers of a month from the sketches of its days, beside the exact number; `near` if within three errors."""
    month = F.trunc("dt", "month")
    guess = S.united(buyer_days(spark, sf), {"month": month})
    exact = src.orders(spark, sf).groupBy(F.trunc("order_time", "month").alias("month")) \
        .agg(F.count_distinct("user_id").alias("buyers"))
    return guess.join(exact, "month").select("month", "buyers", near(S.estimate("keys"), F.col("buyers")).alias("near"))


@query("repeat_buyers_by_year", using("f_orders") + """
, y AS (SELECT DISTINCT year(dt) AS year, user_id FROM f_orders)
SELECT a.year, count(*) AS buyers, count(b.user_id) AS again, 1 AS near
FROM y a LEFT JOIN y b ON b.user_id = a.user_id AND b.year = a.year - 1 GROUP BY a.year""", whole="near")
def _(spark, sf):
    """Buyers of a year who bought the year before too, by intersecting the years' sketches."""
    years = S.united(buyer_days(spark, sf), {"year": F.year("dt")})
    last = years.select((F.col("year") + 1).alias("year"), F.col("keys").alias("before"))
    guess = years.join(last, "year", "left").select(
        "year", F.coalesce(S.in_both("keys", "before"), F.lit(0)).alias("guess"))
    pairs = src.orders(spark, sf).select(F.year("order_time").alias("year"), "user_id").distinct()
    prior = pairs.select((F.col("year") + 1).alias("year"), "user_id", F.lit(1).alias("seen"))
    exact = pairs.join(prior, ["year", "user_id"], "left").groupBy("year").agg(
        F.count(F.lit(1)).alias("buyers"), F.count("seen").alias("again"))
    close = F.abs(F.col("guess") - F.col("again")) <= S.distinct_error(F.col("buyers")) + 0.5
    return guess.join(exact, "year").select("year", "buyers", "again", F.when(close, 1).otherwise(0).alias("near"))


@query("merged_latency", using("probes") + """
SELECT id // 4000 * 4000 AS id_from, count(*) AS probes, 1 AS p50_near, 1 AS p95_near FROM probes GROUP BY 1""",
       whole="p50_near p95_near")
def _(spark, sf):
    """P50 and P95 of four id ranges from their stored sketches; each is ranked among the rows and must keep its error."""
    path = scratch_dir(spark, "latency")
    timed = src.probes(spark, sf).select("id", latency_ms("sink_time", "create_time_ms").alias("ms"))
    ranged = timed.withColumn("part", F.floor(F.col("id") / 1000))
    load_table(S.quantile_sketches(ranged, ["part"], "ms"), path)
    guess = S.merged_quantiles(spark.read.parquet(path), {"id_from": F.floor(F.col("part") / 4) * 4000},
                               {"p50_ms": 0.5, "p95_ms": 0.95})

    def kept(value, p):
        slack, place = S.RANK_ERROR * F.col("n") + 1, F.lit(p) * F.col("n")
        return F.when((F.count_if(F.col("ms") < F.col(value)) <= place + slack)
                      & (F.count_if(F.col("ms") <= F.col(value)) >= place - slack), 1).otherwise(0)
    rows = timed.withColumn("id_from", F.floor(F.col("id") / 4000) * 4000).join(guess, "id_from")
    return rows.groupBy("id_from", "n").agg(kept("p50_ms", 0.5).alias("p50_near"), kept("p95_ms", 0.95).alias("p95_near")) \
        .withColumnRenamed("n", "probes")
