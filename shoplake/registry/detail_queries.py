"""Detail layer: dimensions, facts, price history, stock, order life cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplake.operators.aggregates import duration_stats
from shoplake.operators.changes import suppress_noop, with_init_rows
from shoplake.operators.filters import exclude_types
from shoplake.operators.history import asof_join, build_scd2, build_scd2_multi, price_at, scd2_join
from shoplake.operators.joins import unmatched_count
from shoplake.operators.status import milestones, order_trace, transitions, with_durations
from shoplake.operators.stock import (
    day_end_levels, day_span, deduct_stock, densify, floored_levels, running_stock, stock_per_day, total_stock_by_day)
from shoplake.plans import dwd, dws
from shoplake.registry.base import query
from shoplake.registry.model_sql import using
from shoplake.sources import driver_tables as src


def real_log(spark, sf):
    return exclude_types(src.price_log(spark, sf), ["FINAL"])


def clicked(spark, sf):
    """Events as lines to price: product = user id, at the event time."""
    return src.events(spark, sf).where("event_type in ('view', 'click')").select(
        F.col("event_id").alias("item_id"), F.col("user_id").alias("product_id"),
        F.col("ts").alias("create_time"))


CLICKED = """
, clicked AS (SELECT event_id AS item_id, user_id AS product_id, ts AS create_time FROM events
              WHERE event_type IN ('view','click'))
"""


@query("dwd_dim_user", using("users", "f_orders") + """
SELECT u.user_id, username, phone, province, city, user_level, u.status, register_channel,
       min(order_time) AS first_order_time
FROM users u LEFT JOIN f_orders o ON u.user_id = o.user_id GROUP BY ALL""",
       ts="first_order_time", whole="user_level status")
def _(spark, sf):
    return dwd.dim_user(src.users(spark, sf), src.orders(spark, sf)).select(
        "user_id", "username", "phone", "province", "city", "user_level", "status", "register_channel",
        "first_order_time")


@query("dwd_dim_product", using("products") + """
SELECT product_id, product_name, category, brand, price, cost_price, stock, status,
       CASE WHEN price < 100 THEN '0-100' WHEN price < 1000 THEN '100-1000' WHEN price < 5000 THEN '1000-5000'
            ELSE '5000+' END AS price_band, price - cost_price AS unit_margin
FROM products""", num="price cost_price unit_margin", whole="stock status")
def _(spark, sf):
    return dwd.dim_product(src.products(spark, sf)).select(
        "product_id", "product_name", "category", "brand", "price", "cost_price", "stock", "status",
        "price_band", "unit_margin")


@query("dwd_fact_order_item", using("d_items") + """
SELECT item_id, order_id, product_id, quantity, unit_price, subtotal, discount_amount, category, brand,
       current_price, cost_price, net_amount, current_price_amount, gross_margin, create_time FROM d_items""",
       num="unit_price subtotal discount_amount current_price cost_price net_amount current_price_amount gross_margin",
       ts="create_time", whole="quantity")
def _(spark, sf):
    return dwd.fact_order_item(src.items(spark, sf), src.products(spark, sf)).drop("matched", "dt")


ACC_COLUMNS = ("order_id, user_id, order_status, item_count, total_amount, discount_amount, order_time, pay_time, "
               "shipping_time, complete_time, cancel_time, is_deleted")
DURATIONS = """date_diff('second', order_time, pay_time) AS pay_sec,
       date_diff('second', pay_time, shipping_time) AS ship_sec,
       date_diff('second', shipping_time, complete_time) AS complete_sec"""


@query("dwd_fact_order_acc", using("f_orders") + f"SELECT {ACC_COLUMNS}, {DURATIONS}, dt FROM f_orders",
       num="total_amount discount_amount", day="dt", whole="is_deleted",
       ts="order_time pay_time shipping_time complete_time cancel_time")
def _(spark, sf):
    return dwd.fact_order_acc(src.orders(spark, sf))


@query("duration_stats", using("f_orders") + f"""
, d AS (SELECT {DURATIONS} FROM f_orders),
long AS (SELECT 'pay' AS stage, pay_sec AS sec FROM d UNION ALL SELECT 'ship', ship_sec FROM d
         UNION ALL SELECT 'complete', complete_sec FROM d)
SELECT stage, count(sec) AS orders, round(CAST(sum(sec) AS DOUBLE) / count(sec), 6) AS avg_sec,
       quantile_cont(sec, 0.5) AS p50_sec, round(quantile_cont(sec, 0.95), 6) AS p95_sec
FROM long WHERE sec IS NOT NULL GROUP BY stage""", num="p50_sec")
def _(spark, sf):
    stats = duration_stats(dwd.fact_order_acc(src.orders(spark, sf)))
    return stats.withColumn("p95_sec", F.round("p95_sec", 6))


@query("unmatched_lookup", using("d_items") + """
SELECT count(*) AS lines, sum(CASE WHEN category IS NULL THEN 1 ELSE 0 END) AS unmatched FROM d_items""",
       whole="unmatched")
def _(spark, sf):
    return unmatched_count(dwd.fact_order_item(src.items(spark, sf), src.products(spark, sf)))


# ---- price history ----------------------------------------------------------
@query("build_scd2", using("scd2") + "SELECT * FROM scd2", num="price", ts="price_start_time price_end_time",
       whole="is_current")
def _(spark, sf):
    return build_scd2(real_log(spark, sf))


@query("dwd_dim_product_price_scd2", using("products", "real_log") + """
, firsts AS (SELECT product_id, arg_min(new_price, (change_time, change_id)) AS first_price FROM real_log GROUP BY 1),
full_log AS (
  SELECT -p.product_id - 1 AS change_id, p.product_id, coalesce(first_price, price) AS new_price,
         TIMESTAMP '2023-12-01' AS change_time
  FROM products p LEFT JOIN firsts f ON p.product_id = f.product_id
  UNION ALL SELECT change_id, product_id, new_price, change_time FROM real_log),
marked AS (SELECT *, lag(new_price) OVER w AS prev_price, lag(change_id) OVER w AS prev_id
           FROM (SELECT * FROM full_log QUALIFY row_number() OVER
                 (PARTITION BY product_id, change_time ORDER BY change_id DESC) = 1) AS one_per_instant WINDOW w AS (PARTITION BY product_id ORDER BY change_time, change_id))
SELECT product_id, new_price AS price, change_time AS price_start_time,
       lead(change_time) OVER w AS price_end_time,
       CASE WHEN lead(change_time) OVER w IS NULL THEN 1 ELSE 0 END AS is_current,
       row_number() OVER w AS version_no
FROM marked WHERE prev_id IS NULL OR prev_price <> new_price
WINDOW w AS (PARTITION BY product_id ORDER BY change_time, change_id)""",
       num="price", ts="price_start_time price_end_time", whole="is_current")
def _(spark, sf):
    return dwd.dim_product_price_scd2(real_log(spark, sf), src.products(spark, sf), "2023-12-01 00:00:00")


@query("build_scd2_multi", """
WITH log AS (SELECT user_id, event_type, floor(value / 40) AS level, ts, event_id FROM events),
marked AS (SELECT *, lag(event_type) OVER w AS pe, lag(level) OVER w AS pl, lag(event_id) OVER w AS pid
           FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) AS o
           WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_type, CAST(level AS BIGINT) AS level, ts AS start_time, lead(ts) OVER w AS end_time,
       CASE WHEN lead(ts) OVER w IS NULL THEN 1 ELSE 0 END AS is_current, row_number() OVER w AS version_no
FROM marked WHERE pid IS NULL OR pe <> event_type OR pl <> level
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""", ts="start_time end_time", whole="is_current")
def _(spark, sf):
    log = src.events(spark, sf).select("user_id", "event_type", F.floor(F.col("value") / 40).alias("level"),
                                       "ts", "event_id")
    return build_scd2_multi(log, "user_id", ["event_type", "level"], "ts", "event_id")


@query("suppress_noop", """
WITH w AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p
           FROM events)
SELECT event_id, user_id, event_type FROM w WHERE p IS NULL OR p <> event_type""")
def _(spark, sf):
    log = src.events(spark, sf).select("event_id", "user_id", "event_type", "ts")
    return suppress_noop(log, "user_id", ["event_type"], ["ts", "event_id"]).drop("ts")


@query("asof_join", using("real_log") + CLICKED + """
SELECT item_id, c.product_id, c.create_time, l.new_price AS price_then
FROM clicked c ASOF LEFT JOIN real_log l ON c.product_id = l.product_id AND c.create_time >= l.change_time""",
       num="price_then", ts="create_time")
def _(spark, sf):
    return asof_join(clicked(spark, sf), real_log(spark, sf), "product_id", "create_time", "change_time",
                     {"price_then": "new_price"}, right_seq="change_id")


@query("asof_join_second", using("real_log") + CLICKED + """
, r AS (SELECT product_id, new_price, date_trunc('second', change_time + INTERVAL 500 MILLISECOND) AS at, change_id
        FROM real_log),
c AS (SELECT *, date_trunc('second', create_time + INTERVAL 500 MILLISECOND) AS at FROM clicked),
m AS (SELECT item_id, c.product_id, arg_max(new_price, (r.at, change_id)) AS price_then
      FROM c LEFT JOIN r ON c.product_id = r.product_id AND r.at <= c.at GROUP BY 1, 2)
SELECT * FROM m""", num="price_then")
def _(spark, sf):
    return asof_join(clicked(spark, sf), real_log(spark, sf), "product_id", "create_time", "change_time",
                     {"price_then": "new_price"}, right_seq="change_id", granularity="second").drop("create_time")


@query("price_at", using("real_log", "products") + CLICKED + """
, j AS (SELECT item_id, c.product_id, l.new_price
        FROM clicked c ASOF LEFT JOIN real_log l ON c.product_id = l.product_id AND c.create_time >= l.change_time)
SELECT item_id, j.product_id, coalesce(new_price, price) AS asof_price
FROM j LEFT JOIN products p ON j.product_id = p.product_id""", num="asof_price")
def _(spark, sf):
    return price_at(clicked(spark, sf), real_log(spark, sf), src.products(spark, sf)).drop("create_time")


@query("scd2_join", using("scd2") + CLICKED + """
SELECT item_id, c.product_id, price AS version_price, version_no
FROM clicked c LEFT JOIN scd2 s ON c.product_id = s.product_id AND c.create_time >= price_start_time
     AND (price_end_time IS NULL OR c.create_time < price_end_time)""", num="version_price")
def _(spark, sf):
    return scd2_join(clicked(spark, sf), build_scd2(real_log(spark, sf))).drop("create_time")


@query("with_init_rows", using("real_log", "products") + """
, firsts AS (SELECT product_id, arg_min(new_price, (change_time, change_id)) AS first_price FROM real_log GROUP BY 1)
SELECT -p.product_id - 1 AS change_id, p.product_id, NULL::DOUBLE AS old_price, coalesce(first_price, price) AS new_price,
       'INIT' AS change_type, TIMESTAMP '2023-12-01' AS change_time
FROM products p LEFT JOIN firsts f ON p.product_id = f.product_id
UNION ALL SELECT change_id, product_id, NULL, new_price, change_type, change_time FROM real_log""",
       num="new_price", ts="change_time")
def _(spark, sf):
    return with_init_rows(real_log(spark, sf), src.products(spark, sf), "2023-12-01 00:00:00")


# ---- order life cycle -------------------------------------------------------
@query("fact_order_acc_from_log", using("status_log") + f"""
, m AS (SELECT order_id, min(ts) FILTER (status = 'CREATED') AS order_time, min(ts) FILTER (status = 'PAID') AS pay_time,
               min(ts) FILTER (status = 'SHIPPED') AS shipping_time, min(ts) FILTER (status = 'COMPLETED') AS complete_time,
               min(ts) FILTER (status = 'CANCELLED') AS cancel_time FROM status_log GROUP BY order_id)
SELECT *, datesub('second', order_time, pay_time) AS pay_sec, datesub('second', pay_time, shipping_time) AS ship_sec,
       datesub('second', shipping_time, complete_time) AS complete_sec FROM m""",
       ts="order_time pay_time shipping_time complete_time cancel_time")
def _(spark, sf):
    return with_durations(milestones(src.status_log(spark, sf)))


STEP_OK = """CASE WHEN from_status IS NULL THEN to_status = 'CREATED'
       ELSE from_status || '>' || to_status IN ('CREATED>PAID','PAID>SHIPPED','SHIPPED>COMPLETED',
                                                'CREATED>CANCELLED','PAID>CANCELLED') END"""


@query("transitions", using("status_log") + f"""
, s AS (SELECT order_id, seq, status AS to_status, lag(status) OVER (PARTITION BY order_id ORDER BY seq) AS from_status
        FROM status_log)
SELECT *, CASE WHEN {STEP_OK} THEN 1 ELSE 0 END AS valid FROM s""", whole="valid")
def _(spark, sf):
    return transitions(src.status_log(spark, sf)).drop("ts")


@query("order_trace", using("status_log") + """
SELECT order_id, seq, status, lag(status) OVER w AS from_status, row_number() OVER w AS step_no
FROM status_log WHERE order_id IN (5, 7) OR order_id BETWEEN 20 AND 29 OR order_id >= 140
WINDOW w AS (PARTITION BY order_id ORDER BY seq)""")
def _(spark, sf):
    return order_trace(src.status_log(spark, sf), "5,7,20-29,140-").drop("ts")


# ---- stock ------------------------------------------------------------------
@query("day_end_levels", using("stock_log") + """
SELECT product_id, CAST(change_time AS DATE) AS dt, arg_max(stock_after, (change_time, change_id)) AS last_stock,
       sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS in_qty, sum(CASE WHEN delta < 0 THEN -delta ELSE 0 END) AS out_qty
FROM stock_log GROUP BY 1, 2""", day="dt", whole="last_stock in_qty out_qty")
def _(spark, sf):
    return day_end_levels(src.stock_log(spark, sf))


STOCK_DAYS = using("stock_log", "products") + """
, moves AS (SELECT product_id, CAST(change_time AS DATE) AS d, arg_max(stock_after, (change_time, change_id)) AS last_stock,
            sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS in_qty, sum(CASE WHEN delta < 0 THEN -delta ELSE 0 END) AS out_qty
            FROM stock_log GROUP BY 1, 2),
span AS (SELECT min(CAST(change_time AS DATE)) AS first, max(CAST(change_time AS DATE)) AS last FROM stock_log),
grid AS (SELECT product_id, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS dt FROM products, span),
per_day AS (SELECT g.product_id, g.dt,
       last_value(last_stock IGNORE NULLS) OVER (PARTITION BY g.product_id ORDER BY g.dt) AS day_end_stock,
       coalesce(in_qty, 0) AS in_qty, coalesce(out_qty, 0) AS out_qty
FROM grid g LEFT JOIN moves m ON g.product_id = m.product_id AND g.dt = m.d)
"""


def per_day(spark, sf):
    return stock_per_day(src.products(spark, sf), src.stock_log(spark, sf))


@query("dwd_fact_product_stock_per_day", STOCK_DAYS + "SELECT * FROM per_day", day="dt",
       whole="day_end_stock in_qty out_qty")
def _(spark, sf):
    return per_day(spark, sf)


@query("dws_product_stock_day", STOCK_DAYS + """
SELECT product_id, dt, day_end_stock AS stock, out_qty, CASE WHEN day_end_stock <= 0 THEN 1 ELSE 0 END AS stockout
FROM per_day""", day="dt", whole="stock out_qty stockout")
def _(spark, sf):
    return dws.product_stock_day(per_day(spark, sf))


@query("total_stock_by_day", STOCK_DAYS + "SELECT dt, sum(day_end_stock) AS stock FROM per_day GROUP BY dt",
       day="dt", whole="stock")
def _(spark, sf):
    return total_stock_by_day(per_day(spark, sf))


@query("densify", using("stock_log") + """
SELECT p_partkey AS product_id, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS dt
FROM part, (SELECT min(CAST(change_time AS DATE)) AS first, max(CAST(change_time AS DATE)) AS last FROM stock_log)""", day="dt")
def _(spark, sf):
    return densify(src.products(spark, sf), *day_span(src.stock_log(spark, sf), "change_time"))


@query("stock_from_later_day", using("stock_log", "products") + """
, span AS (SELECT min(CAST(change_time AS DATE)) + 10 AS first, max(CAST(change_time AS DATE)) AS last FROM stock_log),
grid AS (SELECT product_id, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS dt FROM products, span)
SELECT g.product_id, dt, (SELECT arg_max(stock_after, (change_time, change_id)) FROM stock_log l
                          WHERE l.product_id = g.product_id AND CAST(change_time AS DATE) <= g.dt) AS day_end_stock FROM grid g""",
       day="dt", whole="day_end_stock")
def _(spark, sf):
    """Days from the log's eleventh on: the levels of the days before open the first."""
    log = src.stock_log(spark, sf)
    first = log.agg(F.date_add(F.min(F.to_date("change_time")), 10)).first()[0]
    return stock_per_day(src.products(spark, sf), log, start=str(first)).select("product_id", "dt", "day_end_stock")


@query("running_stock", using("stock_log") + """
SELECT change_id, product_id, delta, stock_after,
       sum(delta) OVER (PARTITION BY product_id ORDER BY change_time, change_id ROWS UNBOUNDED PRECEDING) AS running_delta
FROM stock_log""", whole="delta stock_after running_delta")
def _(spark, sf):
    return running_stock(src.stock_log(spark, sf)).drop("order_id", "change_type", "change_time")


@query("floored_levels", using("stock_log") + """
, s AS (SELECT change_id, product_id, change_time, 100 + sum(delta) OVER w AS raw
        FROM stock_log WINDOW w AS (PARTITION BY product_id ORDER BY change_time, change_id ROWS UNBOUNDED PRECEDING))
SELECT change_id, product_id, raw + greatest(0, max(-raw) OVER
       (PARTITION BY product_id ORDER BY change_time, change_id ROWS UNBOUNDED PRECEDING)) AS level FROM s""",
       whole="level")
def _(spark, sf):
    log = src.stock_log(spark, sf).select("change_id", "product_id", "change_time", "delta",
                                          F.lit(100).alias("opening"))
    levels = floored_levels(log, "opening", "delta", "product_id", ["change_time", "change_id"])
    return levels.select("change_id", "product_id", "level")


def lines_to_deduct(spark, sf):
    return src.items(spark, sf).withColumnRenamed("create_time", "order_time")


DEDUCT = using("f_items", "products") + """
, taken AS (SELECT product_id, order_id, sum(quantity) AS qty, min(create_time) AS change_time FROM f_items GROUP BY 1, 2)
"""


@query("deduct_stock_log", DEDUCT + """
SELECT t.product_id, order_id, 'ORDER_DEDUCT' AS change_type, -qty AS delta,
       greatest(stock - sum(qty) OVER (PARTITION BY t.product_id ORDER BY change_time, order_id
                                       ROWS UNBOUNDED PRECEDING), 0) AS stock_after, change_time
FROM taken t JOIN products p ON t.product_id = p.product_id""", ts="change_time", whole="delta stock_after")
def _(spark, sf):
    return deduct_stock(src.products(spark, sf), lines_to_deduct(spark, sf))[1]


@query("deduct_stock", DEDUCT + """
, s AS (SELECT product_id, sum(qty) AS out_qty, max(change_time) AS last_time FROM taken GROUP BY 1)
SELECT p.product_id, greatest(stock - coalesce(out_qty, 0), 0) AS stock, coalesce(last_time, update_time) AS update_time
FROM products p LEFT JOIN s ON p.product_id = s.product_id""", ts="update_time", whole="stock")
def _(spark, sf):
    products, _log = deduct_stock(src.products(spark, sf), lines_to_deduct(spark, sf))
    return products.select("product_id", "stock", "update_time")
