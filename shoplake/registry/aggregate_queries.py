"""Counts, profiles, latency, throughput and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplake.functions.scalars import date_parts, latency_ms
from shoplake.operators import aggregates as A
from shoplake.registry.base import query
from shoplake.registry.model_sql import using
from shoplake.sources import driver_tables as src


@query("table_counts", """
SELECT 'dim_user' AS table_name, count(*) AS row_count FROM customer UNION ALL SELECT 'dim_product', count(*) FROM part
UNION ALL SELECT 'fact_order', count(*) FROM "orders" UNION ALL SELECT 'fact_order_item', count(*) FROM lineitem""")
def _(spark, sf):
    return A.table_counts({"dim_user": src.users(spark, sf), "dim_product": src.products(spark, sf),
                           "fact_order": src.orders(spark, sf), "fact_order_item": src.items(spark, sf)})


STATUS = using("f_orders") + "SELECT order_status, count(*) AS orders FROM f_orders GROUP BY 1"


@query("status_distribution", STATUS)
def _(spark, sf):
    return A.status_distribution(src.orders(spark, sf))


@query("status_distribution_map", using("f_orders") + """
, c AS (SELECT order_status, count(*) AS n FROM f_orders GROUP BY 1)
SELECT '{' || string_agg('"' || order_status || '":' || n, ',' ORDER BY order_status) || '}' AS status_distribution FROM c""")
def _(spark, sf):
    shown = A.status_distribution_map(src.orders(spark, sf))
    return shown.select(F.to_json("status_distribution").alias("status_distribution"))


@query("id_bounds", """
SELECT (SELECT min(o_orderkey) FROM "orders") AS order_min, (SELECT max(o_orderkey) FROM "orders") AS order_max,
       (SELECT min(c_custkey) FROM customer) AS user_min, (SELECT max(c_custkey) FROM customer) AS user_max,
       (SELECT min(p_partkey) FROM part) AS product_min, (SELECT max(p_partkey) FROM part) AS product_max""")
def _(spark, sf):
    return A.id_bounds({"order": (src.orders(spark, sf), "order_id"), "user": (src.users(spark, sf), "user_id"),
                        "product": (src.products(spark, sf), "product_id")})


@query("max_id", using("f_items") + "SELECT coalesce(max(item_id), 0) AS max_id FROM f_items")
def _(spark, sf):
    return A.max_id(src.items(spark, sf), "item_id")


@query("log_profile", using("price_log") + """
SELECT count(*) AS changes, count(DISTINCT product_id) AS products, min(change_time) AS first_time,
       max(change_time) AS last_time FROM price_log""", ts="first_time last_time")
def _(spark, sf):
    return A.log_profile(src.price_log(spark, sf))


@query("order_totals", using("f_items") + """
SELECT order_id, sum(quantity) AS item_count, sum(subtotal) AS subtotal, sum(discount_amount) AS discount_amount,
       count(*) AS lines, sum(subtotal) - sum(discount_amount) AS total_amount FROM f_items GROUP BY 1""",
       num="subtotal discount_amount total_amount", whole="item_count")
def _(spark, sf):
    return A.order_totals(src.items(spark, sf))


@query("latency_stats", using("probes") + """
SELECT id // 1000 * 1000 AS id_from, count(*) AS probes, max(ms) AS max_ms, quantile_cont(ms, 0.5) AS p50_ms,
       round(quantile_cont(ms, 0.95), 6) AS p95_ms FROM probes GROUP BY 1""", num="p50_ms")
def _(spark, sf):
    return A.latency_stats(src.probes(spark, sf), 1000).withColumn("p95_ms", F.round("p95_ms", 6))


@query("latency_stats_approx", using("probes") + """
SELECT id // 1000 * 1000 AS id_from, count(*) AS probes, max(ms) AS max_ms, 1 AS p50_near, 1 AS p95_near
FROM probes GROUP BY 1""", whole="p50_near p95_near")
def _(spark, sf):
    """The sketch's quantiles depend on the engine: each is ranked among the rows and must keep its error bound."""
    accuracy = 1000
    probes = src.probes(spark, sf)
    sketched = A.latency_stats_approx(probes, 1000, accuracy)
    timed = probes.select((F.floor(F.col("id") / 1000) * 1000).alias("id_from"),
                          latency_ms("sink_time", "create_time_ms").alias("ms"))

    def near(value, p):
        slack = F.col("probes") / accuracy + 1
        place = F.lit(float(p)) * F.col("probes")
        return F.when((F.count_if(F.col("ms") < F.col(value)) <= place + slack)
                      & (F.count_if(F.col("ms") <= F.col(value)) >= place - slack), 1).otherwise(0).alias(value[:3] + "_near")
    return timed.join(sketched, "id_from").groupBy("id_from", "probes", "max_ms") \
        .agg(near("p50_ms", 0.5), near("p95_ms", 0.95))


THROUGHPUT = using("probes") + """
, r AS (SELECT count(*) AS rows, min(id) AS first_id, max(id) AS last_id,
               CAST(max(create_time_ms) - min(create_time_ms) AS DOUBLE) / 1000.0::DOUBLE AS wall_sec FROM probes),
s AS (SELECT *, CAST(rows AS DOUBLE) / greatest(0.001, wall_sec) AS v FROM r)
SELECT rows, first_id, last_id, wall_sec, round(v, 6) AS rate,
       round(abs(v - 0.004::DOUBLE) / 0.004::DOUBLE, 6) AS deviation,
       CASE WHEN abs(v - 0.004::DOUBLE) / 0.004::DOUBLE > 0.05 THEN 1 ELSE 0 END AS off_target FROM s"""


@query("throughput", THROUGHPUT, whole="off_target")
def _(spark, sf):
    return A.throughput(src.probes(spark, sf), 0.004)


@query("hour_profile", """
WITH h AS (SELECT hour(ts + INTERVAL 8 HOUR) AS hour, count(*) AS orders FROM events GROUP BY 1)
SELECT hour, orders, round(CAST(orders AS DOUBLE) / CAST(sum(orders) OVER () AS DOUBLE), 6) AS share FROM h""")
def _(spark, sf):
    return A.hour_profile(src.events(spark, sf), "ts", "+08:00")



def measures():
    return {"orders": F.count(F.lit(1)), "amount": F.sum("total_amount")}


@query("date_rollup", using("f_orders") + """
SELECT year(dt) AS year, quarter(dt) AS quarter, month(dt) AS month, count(*) AS orders, sum(total_amount) AS amount,
       3 - grouping(year(dt)) - grouping(quarter(dt)) - grouping(month(dt)) AS level
FROM f_orders GROUP BY ROLLUP (year(dt), quarter(dt), month(dt))""", num="amount")
def _(spark, sf):
    parts = date_parts("order_time")
    return A.hierarchy_rollup(src.orders(spark, sf), {k: parts[k] for k in ("year", "quarter", "month")}, measures())


@query("week_rollup", using("f_orders") + """
SELECT isoyear(dt) AS year, weekofyear(dt) AS week, count(*) AS orders, sum(total_amount) AS amount,
       2 - grouping(isoyear(dt)) - grouping(weekofyear(dt)) AS level
FROM f_orders GROUP BY ROLLUP (isoyear(dt), weekofyear(dt))""", num="amount")
def _(spark, sf):
    levels = {"year": F.extract(F.lit("YEAROFWEEK"), F.col("order_time")), "week": F.weekofyear("order_time")}
    return A.hierarchy_rollup(src.orders(spark, sf), levels, measures())


@query("geo_rollup", using("f_orders", "users") + """
SELECT province, city, count(*) AS orders, sum(total_amount) AS amount, 2 - grouping(province) - grouping(city) AS level
FROM f_orders o JOIN users u ON o.user_id = u.user_id GROUP BY ROLLUP (province, city)""", num="amount")
def _(spark, sf):
    joined = src.orders(spark, sf).join(src.users(spark, sf).select("user_id", "province", "city"), "user_id")
    return A.hierarchy_rollup(joined, {"province": F.col("province"), "city": F.col("city")}, measures())


@query("product_rollup", using("d_items") + """
SELECT category, brand, sum(quantity) AS qty, sum(net_amount) AS net, 2 - grouping(category) - grouping(brand) AS level
FROM d_items GROUP BY ROLLUP (category, brand)""", num="net", whole="qty")
def _(spark, sf):
    from shoplake.registry.mart_queries import lines
    return A.hierarchy_rollup(lines(spark, sf), {"category": F.col("category"), "brand": F.col("brand")},
                              {"qty": F.sum("quantity"), "net": F.sum("net_amount")})


@query("price_band_counts", """
SELECT CASE WHEN p_retailprice < 100 THEN '0-100' WHEN p_retailprice < 1000 THEN '100-1000'
       WHEN p_retailprice < 5000 THEN '1000-5000' ELSE '5000+' END AS price_band, count(*) AS products FROM part GROUP BY 1""")
def _(spark, sf):
    return A.price_band_counts(src.products(spark, sf))
