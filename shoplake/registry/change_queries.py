"""Change-log operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplake.functions.scalars import PRICE
from shoplake.operators import changes as C
from shoplake.operators.filters import exclude_types
from shoplake.registry.base import query
from shoplake.registry.model_sql import using
from shoplake.sources import driver_tables as src


@query("latest_per_key", using("user_changes") + """
, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM user_changes)
SELECT user_id, last_event, amount, update_time, op, seq FROM l WHERE rn = 1 AND op <> 'D'""",
       num="amount", ts="update_time")
def _(spark, sf):
    return C.latest_per_key(src.user_changes(spark, sf), ["user_id"], ["seq"])


@query("delete_tombstones", using("user_changes") + """
, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM user_changes)
SELECT user_id, op, seq FROM l WHERE rn = 1 AND op = 'D'""")
def _(spark, sf):
    latest = C.latest_per_key(src.user_changes(spark, sf), ["user_id"], ["seq"], keep_deletes=True)
    return latest.where("op = 'D'").select("user_id", "op", "seq")


@query("collapse_per_chunk", using("price_log") + """
, n AS (SELECT *, (row_number() OVER (ORDER BY change_time, change_id) - 1) // 500 AS chunk_no FROM price_log)
SELECT chunk_no, product_id, arg_max(new_price, (change_time, change_id)) AS new_price,
       max(change_time) AS change_time, arg_max(change_id, (change_time, change_id)) AS change_id
FROM n GROUP BY 1, 2""", num="new_price", ts="change_time", whole="chunk_no")
def _(spark, sf):
    return C.collapse_per_chunk(src.price_log(spark, sf), 500).select(
        "chunk_no", "product_id", "new_price", "change_time", "change_id")


@query("number_rows", using("price_log") + """
SELECT change_id, product_id, row_number() OVER (ORDER BY change_time, change_id) AS order_no FROM price_log""")
def _(spark, sf):
    return C.number_rows(src.price_log(spark, sf), ["change_time", "change_id"]).select(
        "change_id", "product_id", "order_no")


@query("out_of_order", """
WITH d AS (SELECT user_id, date_trunc('hour', ts) AS h, event_id FROM events),
p AS (SELECT *, lag(h) OVER (PARTITION BY user_id ORDER BY h, event_id) AS prev_time FROM d)
SELECT user_id AS product_id, event_id AS change_id, h AS change_time, prev_time FROM p WHERE h <= prev_time""",
       ts="change_time prev_time")
def _(spark, sf):
    """At hour resolution, so that equal times occur."""
    log = src.events(spark, sf).select(F.col("user_id").alias("product_id"), F.col("event_id").alias("change_id"),
                                       F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("change_time"))
    return C.out_of_order(log)


@query("derive_old_value", using("price_log") + """
SELECT change_id, product_id, new_price, lag(new_price) OVER (PARTITION BY product_id ORDER BY change_time, change_id) AS old_price
FROM price_log""", num="new_price old_price")
def _(spark, sf):
    return C.derive_old_value(src.price_log(spark, sf)).select("change_id", "product_id", "new_price", "old_price")


@query("bracket_changes", using("user_changes") + """
, l AS (SELECT user_id, seq, last_event, amount, lag(seq) OVER w AS p_seq, lag(last_event) OVER w AS p_event,
               lag(amount) OVER w AS p_amount
        FROM user_changes WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT user_id, seq, last_event, amount, CASE WHEN p_seq IS NULL THEN 'I' ELSE 'UA' END AS op, seq AS change_seq FROM l
UNION ALL SELECT user_id, p_seq, p_event, p_amount, 'UB', seq FROM l WHERE p_seq IS NOT NULL""", num="amount")
def _(spark, sf):
    rows = src.user_changes(spark, sf).select("user_id", "seq", "last_event", "amount")
    return C.bracket_changes(rows, ["user_id"], "seq")


@query("event_counters", """
SELECT CAST(user_id % 4 AS VARCHAR) AS entity, event_type AS op, count(*) AS events FROM events GROUP BY 1, 2""")
def _(spark, sf):
    log = src.events(spark, sf).select((F.col("user_id") % 4).cast("string").alias("entity"),
                                       F.col("event_type").alias("op"))
    return C.event_counters(log)


@query("chunk_stats", using("price_log", "products") + """
, n AS (SELECT *, (row_number() OVER (ORDER BY change_time, change_id) - 1) // 500 AS chunk_no FROM price_log),
c AS (SELECT chunk_no, product_id, arg_max(new_price, (change_time, change_id)) AS new_price FROM n GROUP BY 1, 2),
b AS (SELECT *, lag(new_price) OVER (PARTITION BY product_id ORDER BY chunk_no) AS before FROM c),
u AS (SELECT chunk_no, count(*) AS products, count(CASE WHEN coalesce(before, price) <> new_price THEN 1 END) AS updated
      FROM b LEFT JOIN products p ON b.product_id = p.product_id GROUP BY 1),
t AS (SELECT chunk_no, count(*) AS processed FROM n GROUP BY 1)
SELECT t.chunk_no, processed, products, updated, products - updated AS unchanged FROM t JOIN u ON t.chunk_no = u.chunk_no""",
       whole="chunk_no")
def _(spark, sf):
    return C.chunk_stats(src.price_log(spark, sf), src.products(spark, sf), 500)


# ---- batch state steps ------------------------------------------------------
NOW = "2001-12-01 00:00:00"


def due(spark, sf):
    """Orders of every fifth user are due for a step."""
    return src.orders(spark, sf).where("user_id % 5 = 0").select("order_id")


@query("advance_orders", using("f_orders") + f"""
SELECT order_id,
       CASE WHEN user_id % 5 <> 0 THEN order_status ELSE CASE order_status WHEN 'CREATED' THEN 'PAID' WHEN 'PAID' THEN 'SHIPPED'
            WHEN 'SHIPPED' THEN 'COMPLETED' ELSE order_status END END AS order_status,
       CASE WHEN user_id % 5 = 0 AND order_status = 'CREATED' THEN TIMESTAMP '{NOW}' ELSE pay_time END AS pay_time,
       CASE WHEN user_id % 5 = 0 AND order_status = 'PAID' THEN TIMESTAMP '{NOW}' ELSE shipping_time END AS shipping_time,
       CASE WHEN user_id % 5 = 0 AND order_status = 'SHIPPED' THEN TIMESTAMP '{NOW}' ELSE complete_time END AS complete_time,
       CASE WHEN user_id % 5 = 0 AND order_status IN ('CREATED','PAID','SHIPPED') THEN TIMESTAMP '{NOW}' ELSE update_time END AS update_time
FROM f_orders""", ts="pay_time shipping_time complete_time update_time")
def _(spark, sf):
    return C.advance_orders(src.orders(spark, sf), due(spark, sf), NOW).select(
        "order_id", "order_status", "pay_time", "shipping_time", "complete_time", "update_time")


@query("cancel_orders", using("f_orders") + f"""
SELECT order_id, CASE WHEN user_id % 5 = 0 AND order_status IN ('CREATED','PAID') THEN 'CANCELLED' ELSE order_status END AS order_status,
       CASE WHEN user_id % 5 = 0 AND order_status IN ('CREATED','PAID') THEN TIMESTAMP '{NOW}' ELSE cancel_time END AS cancel_time
FROM f_orders""", ts="cancel_time")
def _(spark, sf):
    return C.cancel_orders(src.orders(spark, sf), due(spark, sf), NOW).select("order_id", "order_status", "cancel_time")


@query("deactivate", using("products") + f"""
SELECT product_id, CASE WHEN brand = 'Brand#2' THEN 0 ELSE status END AS status,
       CASE WHEN brand = 'Brand#2' AND status = 1 THEN TIMESTAMP '{NOW}' ELSE update_time END AS update_time
FROM products""", ts="update_time", whole="status")
def _(spark, sf):
    products = src.products(spark, sf)
    return C.deactivate(products, products.where("brand = 'Brand#2'"), "product_id", NOW) \
        .select("product_id", "status", "update_time")


@query("deactivate_users", using("users") + f"""
SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'error') THEN 0 ELSE status END AS status,
       CASE WHEN status = 1 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error') THEN TIMESTAMP '{NOW}'
            ELSE update_time END AS update_time
FROM users""", ts="update_time", whole="status")
def _(spark, sf):
    """Users with an error event close; a user who has closed before keeps the time of it, and no row goes."""
    closing = src.events(spark, sf).where("event_type = 'error'").select("user_id")
    return C.deactivate(src.users(spark, sf), closing, "user_id", NOW).select("user_id", "status", "update_time")


@query("offshelf_log", using("products") + f"""
SELECT product_id, price AS old_price, price AS new_price, 'OFFSHELF' AS change_type, TIMESTAMP '{NOW}' AS change_time
FROM products WHERE brand = 'Brand#2' AND status = 1""", num="old_price new_price", ts="change_time")
def _(spark, sf):
    products = src.products(spark, sf)
    return C.offshelf_log(products, products.where("brand = 'Brand#2'"), NOW)


def adjustments(spark, sf):
    """New prices from the event values, one per product; some fall below the floor."""
    return src.events(spark, sf).groupBy(F.col("user_id").alias("product_id")).agg(
        F.min("value").cast(PRICE).alias("new_price"), (F.max("event_id") % 60 - 40).cast("int").alias("stock_delta"))


ADJUST = using("products") + """
, adj AS (SELECT user_id AS product_id, CAST(min(value) AS DECIMAL(10,2)) AS new_price, max(event_id) % 60 - 40 AS stock_delta
          FROM events GROUP BY 1)
"""


@query("adjust_prices", ADJUST + f"""
SELECT p.product_id,
       CASE WHEN new_price IS NOT NULL AND status = 1 THEN greatest(new_price, 1.00) ELSE price END AS price,
       CASE WHEN new_price IS NOT NULL AND status = 1 THEN greatest(stock + stock_delta, 0) ELSE stock END AS stock,
       CASE WHEN new_price IS NOT NULL AND status = 1 THEN TIMESTAMP '{NOW}' ELSE update_time END AS update_time
FROM products p LEFT JOIN adj a ON p.product_id = a.product_id""", num="price", ts="update_time", whole="stock")
def _(spark, sf):
    return C.adjust_prices(src.products(spark, sf), adjustments(spark, sf), NOW)[0] \
        .select("product_id", "price", "stock", "update_time")


@query("adjust_prices_log", ADJUST + f"""
SELECT p.product_id, price AS old_price, greatest(new_price, 1.00) AS new_price, 'ADJUST' AS change_type, TIMESTAMP '{NOW}' AS change_time
FROM products p JOIN adj a ON p.product_id = a.product_id WHERE status = 1""", num="old_price new_price", ts="change_time")
def _(spark, sf):
    return C.adjust_prices(src.products(spark, sf), adjustments(spark, sf), NOW)[1]


@query("change_types_kept", using("real_log") + """
SELECT change_type, count(*) AS changes FROM real_log GROUP BY 1""")
def _(spark, sf):
    return exclude_types(src.price_log(spark, sf), ["FINAL"]).groupBy("change_type").agg(
        F.count(F.lit(1)).alias("changes"))
