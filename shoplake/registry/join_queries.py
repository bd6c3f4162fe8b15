"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplake.operators import joins as J
from shoplake.operators import sets as U
from shoplake.operators.changes import hard_delete, latest_per_key
from shoplake.plans import dwd
from shoplake.registry.base import query
from shoplake.registry.model_sql import using
from shoplake.session import scratch_dir
from shoplake.sources import driver_tables as src
from shoplake.sources.calendar import calendar_covering
from shoplake.sources.lake import bucket_count, write_bucketed


@query("update_from_aggregate", using("users", "f_orders") + """
, f AS (SELECT user_id, max(order_time) AS last_paid FROM f_orders WHERE pay_time IS NOT NULL GROUP BY 1)
SELECT u.user_id, coalesce(last_paid, update_time) AS update_time FROM users u LEFT JOIN f ON u.user_id = f.user_id""",
       ts="update_time")
def _(spark, sf):
    paid = src.orders(spark, sf).where(F.col("pay_time").isNotNull())
    return J.update_from_aggregate(src.users(spark, sf), paid, "user_id", F.max("order_time"), "update_time",
                                   only_null=False).select("user_id", "update_time")


@query("first_order", using("users", "f_orders") + """
, f AS (SELECT user_id, min(order_time) AS first_order_time FROM f_orders
        WHERE order_status IN ('PAID','SHIPPED','COMPLETED') GROUP BY 1)
SELECT u.user_id, first_order_time FROM users u LEFT JOIN f ON u.user_id = f.user_id""", ts="first_order_time")
def _(spark, sf):
    return J.first_order(src.users(spark, sf), src.orders(spark, sf), ["PAID", "SHIPPED", "COMPLETED"]) \
        .select("user_id", "first_order_time")


@query("lookup_join", using("f_items", "products") + """
SELECT item_id, i.product_id, category, brand, CASE WHEN p.product_id IS NULL THEN 0 ELSE 1 END AS matched
FROM f_items i LEFT JOIN products p ON i.product_id = p.product_id""", whole="matched")
def _(spark, sf):
    return J.lookup_join(src.items(spark, sf), src.products(spark, sf), ["category", "brand"]) \
        .select("item_id", "product_id", "category", "brand", "matched")


@query("header_detail", using("f_orders", "f_items") + """
SELECT item_id, i.order_id, user_id, order_status, quantity, subtotal
FROM f_items i JOIN f_orders o ON i.order_id = o.order_id""", num="subtotal", whole="quantity")
def _(spark, sf):
    head = src.orders(spark, sf).select("order_id", "user_id", "order_status")
    return J.header_detail(head, src.items(spark, sf)).select(
        "item_id", "order_id", "user_id", "order_status", "quantity", "subtotal")


@query("semi_keys", using("f_items") + """
SELECT item_id, order_id FROM f_items WHERE order_id IN (SELECT o_orderkey FROM "orders" WHERE o_orderpriority = '1-URGENT')""")
def _(spark, sf):
    urgent = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderpriority = '1-URGENT'") \
        .select(F.col("o_orderkey").alias("order_id"))
    return J.semi_keys(src.items(spark, sf), urgent, "order_id").select("item_id", "order_id")


GONE = "order_status = 'CANCELLED' AND order_time < TIMESTAMP '1998-01-01'"


def gone(spark, sf):
    return src.orders(spark, sf).where("order_status = 'CANCELLED' and order_time < timestamp_ntz'1998-01-01 00:00:00'")


@query("hard_delete", using("f_orders", "f_items") + f"""
SELECT item_id, order_id FROM f_items WHERE order_id NOT IN (SELECT order_id FROM f_orders WHERE {GONE})""")
def _(spark, sf):
    _orders, left, _events = hard_delete(src.orders(spark, sf), src.items(spark, sf), gone(spark, sf))
    return left.select("item_id", "order_id")


@query("hard_delete_events", using("f_orders", "f_items") + f"""
, g AS (SELECT order_id FROM f_orders WHERE {GONE})
SELECT 'fact_order' AS entity, order_id AS id, 'D' AS op FROM g
UNION ALL SELECT 'fact_order_item', item_id, 'D' FROM f_items WHERE order_id IN (SELECT order_id FROM g)""")
def _(spark, sf):
    return hard_delete(src.orders(spark, sf), src.items(spark, sf), gone(spark, sf))[2]


@query("orphans", using("f_orders", "f_items") + """
SELECT order_id, user_id FROM f_orders WHERE order_id NOT IN (SELECT order_id FROM f_items)""")
def _(spark, sf):
    return J.orphans(src.orders(spark, sf), src.items(spark, sf), "order_id").select("order_id", "user_id")


@query("orders_with_user", using("f_orders", "users") + """
SELECT order_id, o.user_id, province, city, register_channel FROM f_orders o LEFT JOIN users u ON o.user_id = u.user_id""")
def _(spark, sf):
    return J.orders_with_user(src.orders(spark, sf), src.users(spark, sf), ["province", "city", "register_channel"]) \
        .select("order_id", "user_id", "province", "city", "register_channel")


@query("with_date", using("f_orders") + """
SELECT order_id, dt AS date_key, quarter(dt) AS quarter, weekofyear(dt) AS iso_week, isodow(dt) AS day_of_week FROM f_orders""",
       day="date_key")
def _(spark, sf):
    dates = dwd.with_date_parts(calendar_covering(src.orders(spark, sf), "order_time")) \
        .select("date_key", "quarter", "iso_week", "day_of_week")
    return J.with_date(src.orders(spark, sf), dates, "order_time").select(
        "order_id", "date_key", "quarter", "iso_week", "day_of_week")


@query("price_snapshot_vs_current", using("f_items", "products") + """
SELECT item_id, i.product_id, unit_price, price AS current_price, price - unit_price AS price_diff
FROM f_items i JOIN products p ON i.product_id = p.product_id""", num="unit_price current_price price_diff")
def _(spark, sf):
    return J.price_snapshot_vs_current(src.items(spark, sf), src.products(spark, sf)).select(
        "item_id", "product_id", "unit_price", "current_price", "price_diff")


@query("anchor_probe", using("f_orders", "products") + """
, a AS (SELECT DISTINCT product_id * 7919 % (SELECT max(order_id) FROM f_orders) AS anchor FROM products),
n AS (SELECT order_id, row_number() OVER (ORDER BY order_id) AS nr FROM f_orders
      WHERE order_status IN ('CREATED','PAID','SHIPPED')),
s AS (SELECT anchor, nr FROM a ASOF JOIN n ON a.anchor <= n.order_id)
SELECT anchor, i AS probe_no, order_id FROM s CROSS JOIN generate_series(1, 10) t(i) JOIN n ON n.nr = s.nr + i - 1""")
def _(spark, sf):
    """Anchors of all products, spread over the whole range of order keys."""
    last = src.orders(spark, sf).agg(F.max("order_id")).scalar()
    anchors = src.products(spark, sf).select((F.col("product_id") * 7919 % last).alias("anchor"))
    open_orders = src.orders(spark, sf).where("order_status in ('CREATED', 'PAID', 'SHIPPED')")
    return J.anchor_probe(open_orders, anchors, 10)


@query("colocated_join", using("f_orders", "f_items") + """
SELECT o.order_id, order_status, sum(subtotal) AS gross FROM f_orders o JOIN f_items i ON o.order_id = i.order_id GROUP BY 1, 2""",
       num="gross")
def _(spark, sf):
    """Both tables bucketed by order, so the join and the totals need no exchange."""
    root = scratch_dir(spark, "bucketed")
    tag, buckets = root.rsplit("-", 1)[1], bucket_count(src.items(spark, sf).count())
    write_bucketed(src.orders(spark, sf).select("order_id", "order_status"), f"bucketed_orders_{tag}", buckets,
                   "order_id", f"{root}/orders")
    write_bucketed(src.items(spark, sf).select("order_id", "subtotal"), f"bucketed_items_{tag}", buckets,
                   "order_id", f"{root}/items")
    head, lines = spark.table(f"bucketed_orders_{tag}"), spark.table(f"bucketed_items_{tag}")
    return head.join(lines, "order_id").groupBy("order_id", "order_status").agg(F.sum("subtotal").alias("gross"))


@query("shuffle_join", using("f_orders", "f_items") + """
SELECT o.order_id, order_status, sum(subtotal) AS gross FROM f_orders o JOIN f_items i ON o.order_id = i.order_id GROUP BY 1, 2""",
       num="gross")
def _(spark, sf):
    """The same result from the default layout."""
    head = src.orders(spark, sf).select("order_id", "order_status")
    lines = src.items(spark, sf).select("order_id", "subtotal")
    return head.join(lines, "order_id").groupBy("order_id", "order_status").agg(F.sum("subtotal").alias("gross"))


# ---- sets -------------------------------------------------------------------
@query("missing_keys", """
SELECT DISTINCT c_custkey AS user_id FROM customer
WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')""")
def _(spark, sf):
    expected = src.users(spark, sf)
    seen = src.events(spark, sf).where("event_type = 'purchase'")
    return U.missing_keys(expected, seen, "user_id")


@query("diff_tables", using("user_changes") + """
, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM user_changes),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM user_changes WHERE seq % 10 <> 3),
a AS (SELECT user_id, seq FROM l WHERE rn = 1 AND op <> 'D'),
b AS (SELECT user_id, seq FROM e WHERE rn = 1 AND op <> 'D')
SELECT user_id, seq, 'left' AS side, 1 AS copies FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT user_id, seq, 'right', 1 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""", whole="copies")
def _(spark, sf):
    """Two capture paths: one complete, one that lost every tenth event."""
    log = src.user_changes(spark, sf)
    full = latest_per_key(log, ["user_id"], ["seq"]).select("user_id", "seq")
    lossy = latest_per_key(log.where("seq % 10 <> 3"), ["user_id"], ["seq"]).select("user_id", "seq")
    return U.diff_tables(full, lossy)


