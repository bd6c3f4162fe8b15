"""Sources and sinks, through a scratch folder and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplake.functions.scalars import sum_money
from shoplake.model import FACT_ORDER, FACT_ORDER_ITEM
from shoplake.plans.dwd import with_date_parts
from shoplake.plans.warehouse import Span, build, layer_sizes
from shoplake.registry.base import query
from shoplake.registry.model_sql import using
from shoplake.session import scratch_dir
from shoplake.sources import driver_tables as src
from shoplake.sources.calendar import calendar_covering
from shoplake.sources.ids import assign_ids, split_ranges
from shoplake.sources.keyed import KeyedTable
from shoplake.sources.batches import append_changes
from shoplake.sources.lake import (
    load_table, mirror_table, query_in_place, read_changelog, write_partitioned)
from shoplake.sources.tsv import read_tsv, write_tsv

ITEM_COLUMNS = "item_id, order_id, product_id, quantity, unit_price, subtotal, discount_amount, create_time"
ITEM_TYPES = {"num": "unit_price subtotal discount_amount", "ts": "create_time", "whole": "quantity"}
ORDER_TYPES = {"num": "total_amount discount_amount", "whole": "is_deleted",
               "ts": "order_time pay_time shipping_time complete_time cancel_time update_time deleted_time"}
ORDER_COLUMNS = ", ".join(FACT_ORDER.names)


@query("tsv_items", using("f_items") + f"SELECT {ITEM_COLUMNS} FROM f_items", **ITEM_TYPES)
def _(spark, sf):
    path = scratch_dir(spark, "tsv")
    write_tsv(src.items(spark, sf).select(*FACT_ORDER_ITEM.names), path, shards=4)
    return read_tsv(spark, path, FACT_ORDER_ITEM)


@query("tsv_orders_with_nulls", using("f_orders") + f"SELECT {ORDER_COLUMNS} FROM f_orders", **ORDER_TYPES)
def _(spark, sf):
    path = scratch_dir(spark, "tsv")
    write_tsv(src.orders(spark, sf).select(*FACT_ORDER.names), path)
    return read_tsv(spark, path, FACT_ORDER)


@query("tsv_texts", "SELECT doc_id, md5(text) AS hash, length(text) AS chars, lang FROM documents", whole="chars")
def _(spark, sf):
    """Whole texts, with the tabs, newlines and backslashes they hold."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    path = scratch_dir(spark, "tsv")
    write_tsv(docs, path)
    back = read_tsv(spark, path, docs.schema)
    return back.select("doc_id", F.md5("text").alias("hash"), F.length("text").alias("chars"), "lang")


@query("load_table", using("products") + "SELECT product_id, price FROM products", num="price")
def _(spark, sf):
    """Loaded twice, present once."""
    path = scratch_dir(spark, "reload")
    for _run in range(2):
        load_table(src.products(spark, sf), path)
    return spark.read.parquet(path).select("product_id", "price")


@query("write_partitioned", using("f_orders") + """
SELECT order_id, total_amount, dt AS order_date FROM f_orders""",
       num="total_amount", day="order_date")
def _(spark, sf):
    """Written by quarter, re-written for the later quarters, read back whole."""
    path = scratch_dir(spark, "by-quarter")
    orders = src.orders(spark, sf)
    write_partitioned(orders, path, "order_time", "order_quarter", sort_by=["order_id"], grain="quarter")
    late = orders.where("order_time >= timestamp_ntz'1997-04-01 00:00:00'")
    write_partitioned(late, path, "order_time", "order_quarter", grain="quarter")
    return spark.read.parquet(path).select("order_id", "total_amount", F.to_date("order_time").alias("order_date"))


def store_by_order_date(spark, orders, lines, root, grain="day"):
    """Orders and lines in folders by the day of the order (or a wider grain), and the calendar; returns them as read."""
    write_partitioned(orders, f"{root}/orders", "order_time", sort_by=["order_id"], grain=grain)
    dated = lines.join(orders.select("order_id", "order_time"), "order_id")
    write_partitioned(dated, f"{root}/lines", "order_time", sort_by=["order_id"], grain=grain)
    load_table(with_date_parts(calendar_covering(orders, "order_time")), f"{root}/calendar")
    return [spark.read.parquet(f"{root}/{name}") for name in ("orders", "lines", "calendar")]


def week_of_lines(orders, lines, calendar, year, week, grain="day"):
    """Lines and amounts per day of a week; the calendar prunes the folders of both tables at run time."""
    days = calendar.where((F.col("year") == year) & (F.col("iso_week") == week))
    folders = days.select(F.to_date(F.date_trunc(grain, "date_key")).alias("order_date"), F.col("date_key").alias("dt"))

    def of_week(rows):
        return rows.withColumn("dt", F.to_date("order_time")).join(F.broadcast(folders), ["order_date", "dt"])
    sold = of_week(lines).groupBy("dt").agg(F.count(F.lit(1)).alias("lines"), sum_money("subtotal").alias("gross"))
    placed = of_week(orders).groupBy("dt").agg(F.count(F.lit(1)).alias("orders"))
    return placed.join(sold, "dt", "left").withColumnRenamed("dt", "order_date")


@query("tables_by_order_date", using("f_orders", "f_items") + """
, w AS (SELECT * FROM f_orders WHERE year(dt) = 1997 AND weekofyear(dt) = 10)
SELECT w.dt AS order_date, count(DISTINCT w.order_id) AS orders, count(item_id) AS lines, sum(subtotal) AS gross
FROM w LEFT JOIN f_items i ON i.order_id = w.order_id GROUP BY w.dt""", day="order_date", num="gross")
def _(spark, sf):
    """Orders and lines by the date of the order; one week read back through the calendar.

    In the test tables a day holds a handful of rows, so here a folder is a month; a test has folders of days.
    """
    stored = store_by_order_date(spark, src.orders(spark, sf), src.items(spark, sf), scratch_dir(spark, "by-date"), "month")
    found = week_of_lines(*stored, 1997, 10, "month")
    return found.withColumn("lines", F.coalesce("lines", F.lit(0)))


@query("read_changelog", using("user_changes") + "SELECT user_id, op, seq FROM user_changes")
def _(spark, sf):
    path = scratch_dir(spark, "feed")
    changes = src.user_changes(spark, sf)
    load_table(changes, path)
    return read_changelog(spark, path, changes.schema).select("user_id", "op", "seq")


@query("append_changes", using("price_log") + "SELECT change_id, product_id, new_price FROM price_log", num="new_price")
def _(spark, sf):
    """Three batches, the second written twice."""
    path = scratch_dir(spark, "append")
    log = src.price_log(spark, sf)
    for batch in (0, 1, 2, 1):
        append_changes(log.where(F.col("change_id") % 3 == batch), path, batch)
    return spark.read.parquet(path).select("change_id", "product_id", "new_price")


UPSERTED = using("user_changes") + """
, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM user_changes)
SELECT user_id, last_event, amount, update_time, op, seq FROM l WHERE rn = 1 AND op <> 'D'"""


def changes_table(spark, changes):
    return KeyedTable(scratch_dir(spark, "keyed"), changes.schema, ["user_id"], ["seq"])


@query("upsert_sink", UPSERTED, num="amount", ts="update_time")
def _(spark, sf):
    """Newest batch first, one batch again, all the same state."""
    changes = src.user_changes(spark, sf)
    table = changes_table(spark, changes)
    for batch in (3, 1, 2, 0, 1):
        table.append(changes.where(F.floor(F.col("seq") / 7) % 4 == batch), batch)
    return table.current(spark)


@query("upsert_compacted", UPSERTED, num="amount", ts="update_time")
def _(spark, sf):
    """Half the batches folded into a snapshot, the rest on top."""
    changes = src.user_changes(spark, sf)
    table = changes_table(spark, changes)
    for batch in (0, 1):
        table.append(changes.where(F.floor(F.col("seq") / 7) % 4 == batch), batch)
    table.compact(spark)
    for batch in (2, 3):
        table.append(changes.where(F.floor(F.col("seq") / 7) % 4 == batch), batch)
    return table.current(spark)


@query("query_in_place", using("d_items") + """
SELECT category, count(*) AS lines, sum(net_amount) AS net FROM d_items GROUP BY 1""", num="net")
def _(spark, sf):
    from shoplake.registry.mart_queries import lines
    path = scratch_dir(spark, "lake")
    load_table(lines(spark, sf), path)
    return query_in_place(spark, path).groupBy("category").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("net_amount").alias("net"))


@query("mirror_table", using("d_items") + """
SELECT category, count(*) AS lines, sum(net_amount) AS net FROM d_items GROUP BY 1""", num="net")
def _(spark, sf):
    from shoplake.registry.mart_queries import lines
    root = scratch_dir(spark, "mirror")
    load_table(lines(spark, sf), f"{root}/lake")
    mirror = mirror_table(spark, f"{root}/lake", f"{root}/mirror", f"{root}/checkpoint")
    return mirror.groupBy("category").agg(F.count(F.lit(1)).alias("lines"), F.sum("net_amount").alias("net"))


@query("dwd_dim_date", """
SELECT CAST(g AS DATE) AS date_key, year(g) AS year, quarter(g) AS quarter, month(g) AS month, weekofyear(g) AS iso_week,
       isodow(g) AS day_of_week, CASE WHEN isodow(g) >= 6 THEN 1 ELSE 0 END AS is_weekend
FROM generate_series((SELECT min(o_orderdate) FROM "orders"), (SELECT max(o_orderdate) FROM "orders"), INTERVAL 1 DAY) t(g)""",
       day="date_key", whole="is_weekend")
def _(spark, sf):
    return with_date_parts(calendar_covering(src.orders(spark, sf), "order_time"))


@query("assign_ids", """
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) + (SELECT max(o_orderkey) FROM "orders") AS order_id FROM events""")
def _(spark, sf):
    rows = src.events(spark, sf).select("event_id", "ts")
    return assign_ids(rows, ["ts", "event_id"], "order_id", after=src.orders(spark, sf)).drop("ts")


@query("split_ranges", """
WITH n AS (SELECT count(*) AS total, CAST(ceil(count(*) / 7.0) AS BIGINT) AS per FROM "orders")
SELECT s AS shard, s * per AS "start", least(s * per + per, total) AS "end" FROM n, generate_series(0, 6) t(s) WHERE s * per < total""")
def _(spark, sf):
    return split_ranges(spark, src.orders(spark, sf).count(), 7)


@query("warehouse_layers", using("user_day", "product_day", "category_day", "lifetime", "users", "stock_log", "scd2") + """
, span AS (SELECT date_diff('day', min(CAST(change_time AS DATE)), max(CAST(change_time AS DATE))) + 1 AS days FROM stock_log)
SELECT 'ods.dim_user' AS table_name, 'ods' AS layer, count(*) AS row_count FROM users
UNION ALL SELECT 'ods.dim_product', 'ods', count(*) FROM products
UNION ALL SELECT 'ods.fact_order', 'ods', count(*) FROM f_orders
UNION ALL SELECT 'ods.fact_order_item', 'ods', count(*) FROM f_items
UNION ALL SELECT 'ods.fact_product_price_change', 'ods', count(*) FROM price_log
UNION ALL SELECT 'ods.fact_stock_change', 'ods', count(*) FROM stock_log
UNION ALL SELECT 'dwd.dim_date', 'dwd', days FROM span
UNION ALL SELECT 'dwd.dim_user', 'dwd', count(*) FROM users
UNION ALL SELECT 'dwd.dim_product', 'dwd', count(*) FROM products
UNION ALL SELECT 'dwd.dim_product_price_scd2', 'dwd', (SELECT count(*) FROM products) + (SELECT count(*) FROM scd2)
  - (SELECT count(DISTINCT product_id) FROM real_log WHERE product_id IN (SELECT product_id FROM products))
UNION ALL SELECT 'dwd.fact_product_stock_per_day', 'dwd', count(*) * (SELECT days FROM span) FROM products
UNION ALL SELECT 'dws.product_stock_day', 'dws', count(*) * (SELECT days FROM span) FROM products
UNION ALL SELECT 'dws.trade_province_day', 'dws', count(*) FROM (
  SELECT DISTINCT province, dt FROM f_orders o LEFT JOIN users u ON o.user_id = u.user_id)
UNION ALL SELECT 'ads.order_funnel_day', 'ads', count(DISTINCT dt) FROM f_orders
UNION ALL SELECT 'ads.gmv_caliber_compare', 'ads', count(*) FROM (SELECT dt FROM f_orders UNION SELECT dt FROM f_items)
UNION ALL SELECT 'ads.price_divergence_by_category', 'ads', count(*) FROM (SELECT DISTINCT category FROM d_items)
UNION ALL
SELECT 'dws.trade_user_day' AS table_name, 'dws' AS layer, count(*) AS row_count FROM user_day
UNION ALL SELECT 'dws.trade_product_day', 'dws', count(*) FROM product_day
UNION ALL SELECT 'dws.trade_category_day', 'dws', count(*) FROM category_day
UNION ALL SELECT 'dws.user_lifetime', 'dws', count(*) FROM lifetime
UNION ALL SELECT 'dwd.fact_order_acc', 'dwd', count(*) FROM "orders"
UNION ALL SELECT 'dwd.fact_order_item', 'dwd', count(*) FROM lineitem
UNION ALL SELECT 'ads.user_rfm', 'ads', count(*) FROM lifetime
UNION ALL SELECT 'ads.category_rank_day', 'ads', count(*) FROM category_day
UNION ALL SELECT 'ads.trade_overview_day', 'ads', count(DISTINCT o_orderdate) FROM "orders" """)
def _(spark, sf):
    """Every layer built and stored; sizes of all tables."""
    sources = {"dim_user": src.users(spark, sf), "dim_product": src.products(spark, sf),
               "fact_order": src.orders(spark, sf), "fact_order_item": src.items(spark, sf),
               "fact_product_price_change": src.price_log(spark, sf),
               "fact_stock_change": src.stock_log(spark, sf)}
    paths = build(spark, sources, scratch_dir(spark, "warehouse"), Span("2001-08-02", "year"))
    return layer_sizes(spark, paths)
