"""Reconciliation checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplake.model import ORDER_STATUSES, PRICE_CHANGE_TYPES
from shoplake.operators import quality as Q
from shoplake.operators.changes import collapse_per_chunk, derive_old_value, with_init_rows
from shoplake.operators.history import build_scd2
from shoplake.plans import dwd, dws
from shoplake.registry.base import query
from shoplake.registry.detail_queries import CLICKED, clicked, real_log
from shoplake.registry.model_sql import using
from shoplake.sources import driver_tables as src


@query("q_duplicate_keys", using("f_items") + """
SELECT item_id, count(*) AS copies FROM f_items GROUP BY 1 HAVING count(*) > 1""")
def _(spark, sf):
    return Q.duplicate_keys(src.items(spark, sf), ["item_id"])


@query("q_header_vs_lines", using("f_orders", "f_items") + """
, l AS (SELECT order_id, sum(quantity) AS pieces, sum(subtotal) - sum(discount_amount) AS amount,
               sum(discount_amount) AS discount FROM f_items GROUP BY 1)
SELECT o.order_id, item_count - pieces AS count_gap, total_amount - amount AS amount_gap,
       discount_amount - discount AS discount_gap
FROM f_orders o JOIN l ON o.order_id = l.order_id
WHERE item_count <> pieces OR total_amount <> amount OR discount_amount <> discount""",
       num="amount_gap discount_gap", whole="count_gap")
def _(spark, sf):
    return Q.header_vs_lines(src.orders(spark, sf), src.items(spark, sf))


@query("q_line_arithmetic", using("f_items") + """
SELECT item_id, subtotal - quantity * unit_price AS gap FROM f_items WHERE subtotal <> quantity * unit_price""", num="gap")
def _(spark, sf):
    return Q.line_arithmetic(src.items(spark, sf)).select("item_id", "gap")


@query("q_orphans", using("f_orders", "f_items") + """
SELECT 'line_without_order' AS finding, item_id AS id FROM f_items WHERE order_id NOT IN (SELECT order_id FROM f_orders)
UNION ALL SELECT 'order_without_line', order_id FROM f_orders WHERE order_id NOT IN (SELECT order_id FROM f_items)""")
def _(spark, sf):
    return Q.orphans_both_ways(src.orders(spark, sf), src.items(spark, sf))


@query("q_time_not_increasing", """
WITH d AS (SELECT user_id, date_trunc('day', ts) AS h, event_id FROM events),
p AS (SELECT *, lag(h) OVER (PARTITION BY user_id ORDER BY h, event_id) AS prev FROM d)
SELECT user_id AS product_id, count(*) AS bad FROM p WHERE h <= prev GROUP BY 1""")
def _(spark, sf):
    log = src.events(spark, sf).select(F.col("user_id").alias("product_id"), F.col("event_id").alias("change_id"),
                                       F.date_trunc("day", F.col("ts").cast("timestamp")).alias("change_time"))
    return Q.time_not_increasing(log).groupBy("product_id").agg(F.count(F.lit(1)).alias("bad"))


@query("q_replay_completeness", using("price_log") + """
, n AS (SELECT *, (row_number() OVER (ORDER BY change_time, change_id) - 1) // 500 AS chunk_no FROM price_log),
d AS (SELECT arg_max(change_id, (change_time, change_id)) AS change_id FROM n GROUP BY chunk_no, product_id)
SELECT (SELECT count(DISTINCT change_id) FROM price_log) AS expected, (SELECT count(DISTINCT change_id) FROM d) AS processed,
       (SELECT count(*) FROM price_log WHERE change_id NOT IN (SELECT change_id FROM d)) AS missing, 0 AS complete""",
       whole="complete")
def _(spark, sf):
    """A replay that keeps one change per product and chunk is not complete."""
    log = src.price_log(spark, sf)
    return Q.replay_completeness(log, collapse_per_chunk(log, 500), "change_id")


SHIPPED_BY_LINE = using("f_orders", "f_items") + """
, s AS (SELECT order_id, max(create_time) AS shipped FROM f_items GROUP BY 1),
o AS (SELECT f.order_id, order_status, order_time, pay_time, shipped AS shipping_time, complete_time, cancel_time
      FROM f_orders f LEFT JOIN s ON f.order_id = s.order_id)
"""


@query("q_milestone_order", SHIPPED_BY_LINE + """
, c AS (SELECT order_id, order_status,
  CASE WHEN coalesce(pay_time < order_time, false) OR coalesce(shipping_time < pay_time, false)
         OR coalesce(complete_time < shipping_time, false) OR coalesce(cancel_time < order_time, false) THEN 1 ELSE 0 END AS not_in_order,
  CASE WHEN (order_status IN ('PAID','SHIPPED','COMPLETED') AND pay_time IS NULL)
         OR (pay_time IS NOT NULL AND order_status = 'CREATED')
         OR ((order_status IN ('SHIPPED','COMPLETED')) <> (shipping_time IS NOT NULL))
         OR ((order_status = 'COMPLETED') <> (complete_time IS NOT NULL))
         OR ((order_status = 'CANCELLED') <> (cancel_time IS NOT NULL)) THEN 1 ELSE 0 END AS status_mismatch FROM o)
SELECT * FROM c WHERE not_in_order = 1 OR status_mismatch = 1""", whole="not_in_order status_mismatch")
def _(spark, sf):
    """With the last line's ship date as the order's, which breaks the order for many."""
    shipped = src.items(spark, sf).groupBy("order_id").agg(F.max("create_time").alias("_shipped"))
    orders = src.orders(spark, sf).join(shipped, "order_id", "left").withColumn("shipping_time", F.col("_shipped"))
    return Q.milestone_order(orders)


COVERAGE = """SELECT count(*) AS lines, count(version_no) AS matched,
       round(CAST(count(version_no) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM j"""


@query("q_version_coverage", using("scd2") + CLICKED + """
, j AS (SELECT item_id, version_no FROM clicked c LEFT JOIN scd2 s ON c.product_id = s.product_id
        AND c.create_time >= price_start_time AND (price_end_time IS NULL OR c.create_time < price_end_time))
""" + COVERAGE)
def _(spark, sf):
    return Q.version_coverage(clicked(spark, sf), build_scd2(real_log(spark, sf)))


@query("q_version_coverage_with_init", using("products") + CLICKED + """
, j AS (SELECT item_id, p.product_id AS version_no FROM clicked c LEFT JOIN products p ON c.product_id = p.product_id
        AND c.create_time >= TIMESTAMP '2023-12-01')
""" + COVERAGE)
def _(spark, sf):
    """Every product has a version from the range start, so only unknown products miss."""
    log = with_init_rows(real_log(spark, sf), src.products(spark, sf), "2023-12-01 00:00:00")
    return Q.version_coverage(clicked(spark, sf), build_scd2(log))


@query("q_price_chain", using("price_log") + """
, f AS (SELECT *, lag(new_price) OVER (PARTITION BY product_id ORDER BY change_time, change_id) AS old_price FROM price_log),
r AS (SELECT *, lag(new_price) OVER w AS prev_price, lag(change_id) OVER w AS prev_id FROM f WHERE change_type <> 'FINAL'
      WINDOW w AS (PARTITION BY product_id ORDER BY change_time, change_id))
SELECT change_id, product_id, old_price, prev_price FROM r WHERE prev_id IS NOT NULL AND old_price IS DISTINCT FROM prev_price""",
       num="old_price prev_price")
def _(spark, sf):
    """Dropping rows from a closed chain breaks it where they were."""
    log = derive_old_value(src.price_log(spark, sf)).where("change_type <> 'FINAL'")
    return Q.price_chain_breaks(log).select("change_id", "product_id", "old_price", "prev_price")


@query("q_scd2_breaks", using("scd2") + """
, d AS (SELECT *, version_no % 5 = 0 AS cut FROM scd2),
k AS (SELECT *, lead(price_start_time) OVER (PARTITION BY product_id ORDER BY price_start_time) AS nxt FROM d WHERE NOT cut),
g AS (SELECT product_id, count(CASE WHEN nxt IS NOT NULL AND price_end_time < nxt THEN 1 END) AS gaps,
             count(CASE WHEN nxt IS NOT NULL AND (price_end_time IS NULL OR price_end_time > nxt) THEN 1 END) AS "overlaps",
             count(CASE WHEN is_current = 1 THEN 1 END) AS current_rows FROM k GROUP BY 1)
SELECT * FROM g WHERE gaps > 0 OR "overlaps" > 0 OR current_rows <> 1""")
def _(spark, sf):
    """With every fifth version removed, so that there are gaps to find."""
    scd2 = build_scd2(real_log(spark, sf)).where("version_no % 5 <> 0")
    return Q.scd2_breaks(scd2)


SOLD = using("f_items", "products", "real_log") + """
, sold AS (SELECT item_id, product_id, unit_price, create_time FROM f_items UNION ALL
           SELECT -2 * change_id - 1, product_id, new_price, change_time + INTERVAL 400 MILLISECOND FROM real_log UNION ALL
           SELECT -2 * change_id - 2, product_id, new_price, change_time - INTERVAL 400 MILLISECOND FROM real_log)"""


def sold(spark, sf):
    """The lines of the test tables, from before any logged price, and lines about each price change."""
    return src.items(spark, sf).unionByName(src.sold_lines(spark, sf))


@query("q_unit_price", SOLD + """
, c AS (SELECT item_id, i.product_id, unit_price, coalesce(l.new_price, price) AS asof_price
        FROM sold i ASOF LEFT JOIN real_log l ON i.product_id = l.product_id AND i.create_time >= l.change_time
        LEFT JOIN products p ON i.product_id = p.product_id)
SELECT item_id, product_id, unit_price, asof_price FROM c WHERE unit_price IS DISTINCT FROM asof_price""",
       num="unit_price asof_price")
def _(spark, sf):
    return Q.unit_price_mismatch(sold(spark, sf), real_log(spark, sf), src.products(spark, sf), "exact") \
        .select("item_id", "product_id", "unit_price", "asof_price")


@query("q_unit_price_second", SOLD + """
, r AS (SELECT product_id, date_trunc('second', change_time + INTERVAL 500 MILLISECOND) AS at, arg_max(new_price, change_id) AS new_price
        FROM real_log GROUP BY 1, 2),
c AS (SELECT item_id, i.product_id, unit_price, coalesce(r.new_price, price) AS asof_price
      FROM sold i ASOF LEFT JOIN r ON i.product_id = r.product_id AND date_trunc('second', i.create_time + INTERVAL 500 MILLISECOND) >= r.at
      LEFT JOIN products p ON i.product_id = p.product_id)
SELECT item_id, product_id, unit_price, asof_price FROM c WHERE unit_price IS DISTINCT FROM asof_price""",
       num="unit_price asof_price")
def _(spark, sf):
    """Times rounded to seconds: some of the lines 400 ms early now have the price they were sold at."""
    return Q.unit_price_mismatch(sold(spark, sf), real_log(spark, sf), src.products(spark, sf), "second") \
        .select("item_id", "product_id", "unit_price", "asof_price")


@query("q_current_price", using("products", "real_log") + """
, l AS (SELECT product_id, arg_max(new_price, (change_time, change_id)) AS last_price FROM real_log GROUP BY 1)
SELECT p.product_id, price, last_price FROM products p JOIN l ON p.product_id = l.product_id WHERE price <> last_price""",
       num="price last_price")
def _(spark, sf):
    return Q.current_price_mismatch(src.products(spark, sf), real_log(spark, sf))


@query("q_stock_gap", using("stock_log") + """
, l AS (SELECT product_id, arg_max(stock_after, (change_time, change_id)) AS last_stock, sum(delta) AS sum_delta FROM stock_log GROUP BY 1)
SELECT *, last_stock - sum_delta AS gap FROM l WHERE last_stock <> sum_delta""", whole="last_stock sum_delta gap")
def _(spark, sf):
    return Q.stock_gap(src.stock_log(spark, sf))


@query("q_outside_domain", using("price_log") + """
SELECT 'change_type' AS column_name, change_type AS value, count(*) AS rows FROM price_log
WHERE change_type NOT IN ('INIT','ADJUST','OFFSHELF','ONSHELF') GROUP BY 2
UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM "orders"
WHERE o_orderstatus NOT IN ('CREATED','PAID','SHIPPED','COMPLETED','CANCELLED') GROUP BY 2""")
def _(spark, sf):
    raw = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderstatus")
    return Q.outside_domain(src.price_log(spark, sf), "change_type", PRICE_CHANGE_TYPES) \
        .unionByName(Q.outside_domain(raw, "o_orderstatus", ORDER_STATUSES))


@query("q_below_floor", using("price_log") + "SELECT change_id, new_price AS value FROM price_log WHERE new_price < 1.00",
       num="value")
def _(spark, sf):
    return Q.below_floor(src.price_log(spark, sf), "change_id", "new_price", "1.00")


@query("q_city_outside_province", """
SELECT c_custkey AS user_id, n_name AS city, r_name AS province FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = (n_regionkey + CASE WHEN c_custkey % 20 = 0 THEN 1 ELSE 0 END) % 5
WHERE c_custkey % 20 = 0""")
def _(spark, sf):
    """Every twentieth user's province is moved to the next region."""
    n, r = spark.read.parquet(f"{sf}/nation.parquet"), spark.read.parquet(f"{sf}/region.parquet")
    known = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("province"), F.col("n_name").alias("city"))
    moved = F.when(F.col("c_custkey") % 20 == 0, 1).otherwise(0)
    users = spark.read.parquet(f"{sf}/customer.parquet").join(n, F.col("c_nationkey") == F.col("n_nationkey")) \
        .join(r, F.col("r_regionkey") == (F.col("n_regionkey") + moved) % 5) \
        .select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("city"), F.col("r_name").alias("province"))
    return Q.city_outside_province(users, known).select("user_id", "city", "province")


@query("q_caliber_drift", using("f_orders") + """
, s AS (SELECT count(*) AS all_orders, count(CASE WHEN order_status = 'CANCELLED' THEN 1 END) AS all_cancelled,
               count(CASE WHEN is_deleted = 0 THEN 1 END) AS kept_orders,
               count(CASE WHEN is_deleted = 0 AND order_status = 'CANCELLED' THEN 1 END) AS kept_cancelled FROM f_orders)
SELECT *, round(CAST(all_cancelled AS DOUBLE) / all_orders, 6) AS cancel_rate,
       round(CAST(kept_cancelled AS DOUBLE) / kept_orders, 6) AS cancel_rate_after_removal FROM s""")
def _(spark, sf):
    return Q.caliber_drift(src.orders(spark, sf))


@query("q_rate_check", using("probes") + """
, r AS (SELECT count(*) AS rows, min(id) AS first_id, max(id) AS last_id,
               CAST(max(create_time_ms) - min(create_time_ms) AS DOUBLE) / 1000.0::DOUBLE AS wall_sec FROM probes),
s AS (SELECT *, CAST(rows AS DOUBLE) / greatest(0.001, wall_sec) AS v FROM r)
SELECT rows, first_id, last_id, wall_sec, round(v, 6) AS rate, round(abs(v - 1.0::DOUBLE), 6) AS deviation,
       CASE WHEN abs(v - 1.0::DOUBLE) > 0.05 THEN 1 ELSE 0 END AS off_target FROM s""", whole="off_target")
def _(spark, sf):
    return Q.rate_check(src.probes(spark, sf), 1.0)


@query("q_update_time_regressions", using("arrivals") + """
, p AS (SELECT event_id, user_id, arrival, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY arrival, event_id) AS prev_time FROM arrivals)
SELECT event_id, user_id, ts AS update_time, prev_time FROM p WHERE ts < prev_time""", ts="update_time prev_time")
def _(spark, sf):
    """In arrival order the late events step back in time."""
    log = src.arrivals(spark, sf).withColumn("seq", F.col("arrival") * 2 - F.when(F.col("event_id") == F.col("arrival"), 0).otherwise(1)) \
        .withColumnRenamed("ts", "update_time")
    return Q.update_time_regressions(log, "user_id", "seq").select("event_id", "user_id", "update_time", "prev_time")


@query("q_grid_coverage", using("category_day") + """
, g AS (SELECT count(*) AS rows, count(DISTINCT category) AS keys_a, count(DISTINCT dt) AS keys_b FROM category_day)
SELECT *, keys_a * keys_b - rows AS missing, CASE WHEN keys_a * keys_b = rows THEN 1 ELSE 0 END AS complete FROM g""",
       whole="missing complete")
def _(spark, sf):
    lines = dwd.fact_order_item(src.items(spark, sf), src.products(spark, sf))
    return Q.grid_coverage(dws.trade_category_day(lines), "category", "dt")


@query("q_stock_trail", using("stock_log") + """
SELECT change_id, stock_after, sum(delta) OVER (PARTITION BY product_id ORDER BY change_time, change_id ROWS UNBOUNDED PRECEDING) AS running_delta
FROM stock_log""", whole="stock_after running_delta")
def _(spark, sf):
    return Q.stock_trail(src.stock_log(spark, sf)).select("change_id", "stock_after", "running_delta")
