"""Filters, guarded updates, top-n and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplake.functions.idranges import id_range_filter, in_ranges, merge_intervals, range_size
from shoplake.operators import filters as O
from shoplake.operators.sets import any_of, union_shards
from shoplake.registry.base import query
from shoplake.registry.model_sql import using
from shoplake.sources import driver_tables as src

RANGES = "1,5,10-20,21-30,100-2000,9000-"


@query("id_range_filter", using("f_orders") + """
SELECT order_id, user_id FROM f_orders
WHERE order_id = 1 OR order_id = 5 OR order_id BETWEEN 10 AND 30 OR order_id BETWEEN 100 AND 2000 OR order_id >= 9000""")
def _(spark, sf):
    return src.orders(spark, sf).where(id_range_filter(RANGES, "order_id")).select("order_id", "user_id")


@query("union_of_filters", using("f_orders") + """
SELECT order_id, user_id FROM f_orders WHERE order_id IN (3, 4, 9) OR order_id BETWEEN 50 AND 60 OR user_id < 20""")
def _(spark, sf):
    return src.orders(spark, sf).where(any_of(id_range_filter("3,4,9", "order_id"),
                                              id_range_filter("50-60", "order_id"),
                                              F.col("user_id") < 20)).select("order_id", "user_id")


def spans(spark, sf):
    """A range per order: from its day number, as long as its key's last digits."""
    day = F.datediff("order_time", F.lit("1995-01-01"))
    return src.orders(spark, sf).select("user_id", day.alias("lo"),
                                        (day + (F.col("order_id") % 90).cast("int")).alias("hi"))


SPANS = using("f_orders") + """
, spans AS (SELECT user_id, date_diff('day', DATE '1995-01-01', dt) AS lo,
                   date_diff('day', DATE '1995-01-01', dt) + order_id % 90 AS hi FROM f_orders)
"""


@query("merge_intervals", SPANS + """
, m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 1 THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY user_id, island""")
def _(spark, sf):
    return merge_intervals(spans(spark, sf), by=("user_id",))


@query("in_ranges", """
WITH r AS (SELECT p_partkey * 10 AS lo, p_partkey * 10 + p_size % 9 AS hi FROM part)
SELECT o_orderkey AS order_id FROM "orders" o WHERE EXISTS (SELECT 1 FROM r WHERE o.o_orderkey BETWEEN lo AND hi)""")
def _(spark, sf):
    ranges = spark.read.parquet(f"{sf}/part.parquet").select(
        (F.col("p_partkey") * 10).alias("lo"), (F.col("p_partkey") * 10 + F.col("p_size") % 9).alias("hi"))
    return in_ranges(src.orders(spark, sf).select("order_id"), ranges, "order_id")


@query("range_size", SPANS + """
, m AS (SELECT *, max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
        FROM (SELECT DISTINCT lo, hi FROM spans)),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 1 THEN 1 ELSE 0 END)
             OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m),
g AS (SELECT min(lo) AS lo, max(hi) AS hi FROM i GROUP BY island)
SELECT sum(hi - lo + 1) AS ids FROM g""", whole="ids")
def _(spark, sf):
    """Size of the union of all users' ranges."""
    sized = range_size(merge_intervals(spans(spark, sf).select("lo", "hi")))
    return sized.withColumn("ids", F.col("ids").cast("bigint"))


@query("active_only", using("users") + "SELECT user_id, username FROM users WHERE status = 1 AND is_deleted = 0")
def _(spark, sf):
    return O.project(O.active_only(src.users(spark, sf)), ["user_id", "username"])


@query("status_in", using("f_orders") + """
SELECT order_id, order_status FROM f_orders WHERE order_status IN ('CREATED','PAID','SHIPPED')""")
def _(spark, sf):
    return O.project(O.status_in(src.orders(spark, sf), ["CREATED", "PAID", "SHIPPED"]), ["order_id", "order_status"])


@query("stale_orders", using("f_orders") + """
SELECT order_id, update_time FROM f_orders
WHERE update_time < TIMESTAMP '2000-01-01' - INTERVAL 4320 MINUTE AND order_status = 'CANCELLED'""", ts="update_time")
def _(spark, sf):
    return O.stale(src.orders(spark, sf), "2000-01-01 00:00:00", 4320, "CANCELLED").select("order_id", "update_time")


@query("exclude_types", using("price_log") + """
SELECT change_id, product_id, change_type FROM price_log WHERE change_type NOT IN ('FINAL')""")
def _(spark, sf):
    return O.exclude_types(src.price_log(spark, sf), ["FINAL"]).select("change_id", "product_id", "change_type")


@query("time_slice", using("price_log") + """
SELECT change_id, change_time FROM price_log
WHERE change_time >= TIMESTAMP '2024-01-10' AND change_time < TIMESTAMP '2024-01-12 12:00:00'""", ts="change_time")
def _(spark, sf):
    return O.time_slice(src.price_log(spark, sf), "2024-01-10 00:00:00", "2024-01-12 12:00:00") \
        .select("change_id", "change_time")


@query("changed_only", using("f_items", "products") + """
SELECT item_id, unit_price, price FROM f_items i JOIN products p ON i.product_id = p.product_id
WHERE unit_price IS DISTINCT FROM price""", num="unit_price price")
def _(spark, sf):
    joined = src.items(spark, sf).join(src.products(spark, sf).select("product_id", "price"), "product_id")
    return O.changed_only(joined, "unit_price", "price").select("item_id", "unit_price", "price")


@query("incremental_read", using("f_orders") + """
SELECT order_id, update_time, deleted_time FROM f_orders
WHERE greatest(update_time, deleted_time) > TIMESTAMP '2001-06-01'""", ts="update_time deleted_time")
def _(spark, sf):
    return O.incremental_read(src.orders(spark, sf), "2001-06-01 00:00:00") \
        .select("order_id", "update_time", "deleted_time")


LAST_PRICE = """
, last AS (SELECT product_id, arg_max(new_price, (change_time, change_id)) AS new_price, max(change_time) AS seen
           FROM price_log GROUP BY 1)
"""


@query("apply_value_map", using("products", "price_log") + LAST_PRICE + """
SELECT p.product_id, coalesce(new_price, price) AS price, CASE WHEN new_price <> price THEN seen ELSE update_time END AS update_time
FROM products p LEFT JOIN last l ON p.product_id = l.product_id""", num="price", ts="update_time")
def _(spark, sf):
    last = src.price_log(spark, sf).groupBy("product_id").agg(
        F.max_by("new_price", F.struct("change_time", "change_id")).alias("price"),
        F.max("change_time").alias("update_time"))
    return O.apply_value_map(src.products(spark, sf), last, "product_id", ["price", "update_time"], guard="price") \
        .select("product_id", "price", "update_time")


@query("set_when", using("f_orders") + """
SELECT order_id, CASE WHEN order_status = 'CREATED' THEN 'PAID' ELSE order_status END AS order_status,
       CASE WHEN order_status = 'CREATED' THEN TIMESTAMP '2001-09-01' ELSE pay_time END AS pay_time FROM f_orders""",
       ts="pay_time")
def _(spark, sf):
    return O.set_when(src.orders(spark, sf), F.col("order_status") == "CREATED",
                      {"pay_time": O.moment("2001-09-01 00:00:00"), "order_status": F.lit("PAID")}) \
        .select("order_id", "order_status", "pay_time")


@query("soft_delete", using("f_orders") + """
, doomed AS (SELECT order_id FROM f_orders WHERE order_status = 'CANCELLED' AND is_deleted = 0
             AND update_time < TIMESTAMP '2001-01-01' ORDER BY update_time, order_id LIMIT 200)
SELECT order_id, CASE WHEN order_id IN (SELECT order_id FROM doomed) THEN 1 ELSE is_deleted END AS is_deleted,
       CASE WHEN order_id IN (SELECT order_id FROM doomed) THEN TIMESTAMP '2001-09-01' ELSE deleted_time END AS deleted_time,
       update_time FROM f_orders""", ts="deleted_time update_time", whole="is_deleted")
def _(spark, sf):
    condition = (F.col("order_status") == "CANCELLED") & (F.col("update_time") < O.moment("2001-01-01 00:00:00"))
    return O.soft_delete(src.orders(spark, sf), condition, "2001-09-01 00:00:00", "order_id", limit=200) \
        .select("order_id", "is_deleted", "deleted_time", "update_time")


@query("oldest_n", using("f_orders") + """
SELECT order_id, update_time FROM f_orders WHERE order_status = 'CANCELLED' ORDER BY update_time, order_id LIMIT 50""",
       ts="update_time")
def _(spark, sf):
    return O.oldest_n(O.status_in(src.orders(spark, sf), ["CANCELLED"]), 50).select("order_id", "update_time")


@query("keyset_page", using("price_log") + """
SELECT change_id, change_time FROM price_log
WHERE change_time > TIMESTAMP '2024-01-10' OR (change_time = TIMESTAMP '2024-01-10' AND change_id > 3000)
ORDER BY change_time, change_id LIMIT 500""", ts="change_time")
def _(spark, sf):
    return O.keyset_page(src.price_log(spark, sf), ("2024-01-10 00:00:00", 3000), 500).select("change_id", "change_time")


@query("replay_order", using("price_log") + """
SELECT change_id, product_id, change_time FROM price_log ORDER BY change_time, change_id""", ts="change_time")
def _(spark, sf):
    return O.replay_order(src.price_log(spark, sf)).select("change_id", "product_id", "change_time")


@query("pool", using("users") + """
SELECT user_id, username FROM users WHERE status = 1 AND is_deleted = 0 ORDER BY md5(user_id || ':7'), user_id LIMIT 500""")
def _(spark, sf):
    return O.pool(O.active_only(src.users(spark, sf)), 500, "user_id", seed=7).select("user_id", "username")


@query("pick_n_per_group", using("products") + """
SELECT category, product_id FROM products
QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5(product_id || ':7'), product_id) <= 20""")
def _(spark, sf):
    return O.pick_n_per_group(src.products(spark, sf), ["category"], 20, "product_id", seed=7) \
        .select("category", "product_id")


@query("union_shards", """
SELECT o_orderkey AS order_id, o_orderstatus AS code FROM "orders" """)
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("order_id"),
                                                             F.col("o_orderstatus").alias("code"))
    return union_shards(*[orders.where(F.col("code") == c) for c in ("F", "O", "P")])


