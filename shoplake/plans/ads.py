"""Report layer, computed from summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplake.functions.scalars import ratio
from shoplake.operators.ordered import ordered_scan
from shoplake.session import scratch_dir


def trade_overview_day(user_day: DataFrame) -> DataFrame:
    """A user-day row is one buyer on that day, so buyers are a plain count."""
    sums = user_day.groupBy("dt").agg(
        F.count(F.lit(1)).alias("buyers"), F.sum("order_cnt").alias("orders"),
        F.sum("order_amt").alias("order_amt"), F.sum("paid_amt").alias("paid_amt"),
        F.sum("paid_cnt").alias("_paid"), F.sum("cancelled_cnt").alias("_cancelled"))
    return sums.select("dt", "buyers", "orders", "order_amt", "paid_amt",
                       ratio("order_amt", "orders").alias("avg_order_value"),
                       ratio("_paid", "orders").alias("pay_rate"),
                       ratio("_cancelled", "orders").alias("cancel_rate"))


def order_funnel_day(user_day: DataFrame) -> DataFrame:
    steps = user_day.groupBy("dt").agg(
        F.sum("order_cnt").alias("ordered"), F.sum("paid_cnt").alias("paid"),
        F.sum("shipped_cnt").alias("shipped"), F.sum("completed_cnt").alias("completed"))
    return steps.select("*", ratio("paid", "ordered").alias("pay_rate"),
                        ratio("shipped", "paid").alias("ship_rate"),
                        ratio("completed", "shipped").alias("complete_rate"))


def category_rank_day(category_day: DataFrame) -> DataFrame:
    """Rank and share of each category per day (a day has one row per category)."""
    day = Window.partitionBy("dt")
    return category_day.select(
        "dt", "category", "net_amt",
        F.rank().over(day.orderBy(F.desc("net_amt"))).alias("rank"),
        ratio("net_amt", F.sum("net_amt").over(day)).alias("share"))


def top_k_categories(category_day: DataFrame, dt: str, k: int) -> DataFrame:
    """The day's filter reaches the summary scan before anything is ranked."""
    one_day = category_day.where(F.col("dt") == F.lit(dt).cast("date"))
    return category_rank_day(one_day).where(F.col("rank") <= k)


def quintiles(df: DataFrame, metrics: dict[str, str], key: str, pieces: int | None = None) -> DataFrame:
    """Exact ntile(5) of each metric ({score: metric}), ties by key, without one big window.

    The input is stored once. One ordered scan over (metric, value, key), which splits
    anywhere, finds the rows at the four boundaries of all metrics; every row is then
    compared with four (value, key) pairs a metric.
    """
    path = scratch_dir(df.sparkSession, "scored")
    df.write.parquet(path)
    base = df.sparkSession.read.schema(df.schema).parquet(path)
    total = base.agg(F.count(F.lit(1))).scalar()
    ends = [F.floor(total / 5) * i + F.least(F.lit(i), total % 5) for i in range(1, 5)]
    number = F.explode(F.array(*[F.lit(m) for m in range(len(metrics))])).alias("_metric")
    values = [F.when(F.col("_metric") == m, F.col(c)).alias(f"_v{m}") for m, c in enumerate(metrics.values())]
    tall = base.select(number, key, *metrics.values()).select("_metric", *values, key)
    placed = ordered_scan(tall, ["_metric"], [f"_v{m}" for m in range(len(metrics))] + [key],
                          number="_nr", pieces=pieces)
    edges = placed.agg(F.struct(*[
        F.max(F.when((F.col("_metric") == m) & (F.col("_nr") == end), F.struct(F.col(f"_v{m}").alias(c), key)))
        .alias(f"m{m}e{i}") for m, c in enumerate(metrics.values()) for i, end in enumerate(ends)]))
    out = base.withColumn("_edges", edges.scalar())
    for m, (score, c) in enumerate(metrics.items()):
        # Fewer rows than buckets: the repeated edges never count a row upwards.
        above = [F.when(F.struct(c, key) > F.col(f"_edges.m{m}e{i}"), 1).otherwise(0) for i in range(4)]
        out = out.withColumn(score, sum(above, F.lit(1)))
    return out.drop("_edges")


def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    """Eight classes by whether each score is in the top two quintiles."""
    value = F.when(m >= 4, "important").otherwise("general")
    kind = (F.when((r >= 4) & (f >= 4), "value").when(f >= 4, "keep")
            .when(r >= 4, "develop").otherwise("retain"))
    return F.concat_ws(" ", value, kind)


def user_rfm(lifetime: DataFrame, as_of: str, pieces: int | None = None) -> DataFrame:
    base = lifetime.select(
        "user_id", F.date_diff(F.lit(as_of).cast("date"), F.to_date("last_order_time")).alias("recency_days"),
        F.col("order_cnt").alias("frequency"), F.col("paid_amt").alias("monetary"))
    scored = quintiles(base, {"_r": "recency_days", "f_score": "frequency", "m_score": "monetary"},
                       "user_id", pieces)
    scored = scored.withColumn("r_score", F.lit(6) - F.col("_r"))
    return scored.select("user_id", "recency_days", "frequency", "monetary", "r_score", "f_score", "m_score",
                         rfm_segment(F.col("r_score"), F.col("f_score"), F.col("m_score")).alias("segment"))


def gmv_caliber_compare(product_day: DataFrame, user_day: DataFrame) -> DataFrame:
    """Gross, net and paid GMV of a day side by side; a day missing in one mart stays."""
    lines = product_day.groupBy("dt").agg(F.sum("gross_amt").alias("gross_gmv"),
                                          F.sum("net_amt").alias("net_gmv"))
    orders = user_day.groupBy("dt").agg(F.sum("paid_amt").alias("paid_gmv"))
    return lines.join(orders, "dt", "full_outer").select(
        "dt", "gross_gmv", "net_gmv", "paid_gmv",
        (F.col("gross_gmv") - F.col("net_gmv")).alias("gross_net_gap"),
        (F.col("net_gmv") - F.col("paid_gmv")).alias("net_paid_gap"),
        (F.col("gross_gmv") - F.col("paid_gmv")).alias("gross_paid_gap"))


def price_divergence_by_category(category_day: DataFrame) -> DataFrame:
    """Amount at the price paid beside the amount at today's price."""
    sums = category_day.groupBy("category").agg(F.sum("gross_amt").alias("snapshot_amt"),
                                                F.sum("current_price_amt").alias("current_price_amt"))
    diff = F.col("current_price_amt") - F.col("snapshot_amt")
    return sums.select("*", diff.alias("diff_amt"), ratio(diff, "snapshot_amt").alias("diff_ratio"))
