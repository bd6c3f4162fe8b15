"""Scalar functions over whole columns of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplake.functions import scalars as X
from shoplake.functions.textfields import escape_field, unescape_field
from shoplake.registry.base import query
from shoplake.registry.model_sql import using
from shoplake.sources import driver_tables as src


@query("money_cents", """
SELECT l_orderkey * 10 + l_linenumber AS item_id, l_extendedprice AS amount,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS cents,
       CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS DECIMAL(18,0)) * 0.01 AS back,
       round(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.125, 2) AS eighth
FROM lineitem""", num="back eighth")
def _(spark, sf):
    amount = F.col("l_extendedprice").cast("decimal(12,2)")
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"),
        F.col("l_extendedprice").alias("amount"), X.to_cents(amount).alias("cents"),
        X.from_cents(X.to_cents(amount)).alias("back"),
        X.money(amount * F.lit("0.125").cast("decimal(4,3)")).alias("eighth"))


@query("line_amounts", using("f_items", "products") + """
SELECT item_id, i.product_id, quantity * unit_price AS subtotal, i.subtotal - discount_amount AS net,
       i.subtotal - discount_amount - quantity * cost_price AS margin
FROM f_items i JOIN products p ON i.product_id = p.product_id""", num="subtotal net margin")
def _(spark, sf):
    joined = src.items(spark, sf).join(src.products(spark, sf).select("product_id", "cost_price"), "product_id")
    net = X.line_net("subtotal", "discount_amount")
    return joined.select("item_id", "product_id", X.line_subtotal("quantity", "unit_price").alias("subtotal"),
                         net.alias("net"), X.margin(net, "quantity", "cost_price").alias("margin"))


@query("floors", """
SELECT event_id, greatest(CAST(value AS DECIMAL(10,2)), 1.00) AS price,
       greatest(CAST(floor(value) AS INTEGER) - 20, 0) AS stock FROM events""", num="price", whole="stock")
def _(spark, sf):
    return src.events(spark, sf).select(
        "event_id", X.price_floor(F.col("value").cast("decimal(10,2)")).alias("price"),
        X.stock_floor(F.floor("value").cast("int") - 20).alias("stock"))


@query("format_ts", """
SELECT event_id, strftime(make_timestamp((epoch_us(ts) // 1000) * 1000) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S.%g') AS local_text
FROM events""")
def _(spark, sf):
    return src.probes(spark, sf).select(F.col("id").alias("event_id"),
                                        X.format_ts("create_time_ms", "+08:00").alias("local_text"))


@query("parse_ts", """
SELECT event_id, epoch_ms(date_trunc('second', ts)) - 8 * 3600 * 1000 AS with_offset,
       epoch_ms(date_trunc('second', ts)) AS wall FROM events""")
def _(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return src.events(spark, sf).select(
        "event_id", X.parse_ts(F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("+08:00"))).alias("with_offset"),
        X.parse_ts(text).alias("wall"))


@query("day_index", """
SELECT event_id, CAST(floor(((epoch_us(ts) // 1000) - 1705276800000) / 86400000.0) AS BIGINT) AS day_no FROM events""")
def _(spark, sf):
    """Days since 2024-01-15, negative before."""
    return src.events(spark, sf).select("event_id", X.day_index("ts", 1705276800000).alias("day_no"))


@query("local_day", "SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS local_day FROM events", day="local_day")
def _(spark, sf):
    return src.events(spark, sf).select("event_id", F.to_date(X.local_day("ts", "+08:00")).alias("local_day"))


@query("price_band", """
SELECT event_id, CASE WHEN value * 30 < 100 THEN '0-100' WHEN value * 30 < 1000 THEN '100-1000'
       WHEN value * 30 < 5000 THEN '1000-5000' ELSE '5000+' END AS price_band FROM events""")
def _(spark, sf):
    return src.events(spark, sf).select("event_id", X.price_band(F.col("value") * 30).alias("price_band"))


@query("order_age", using("f_orders") + """
, a AS (SELECT order_id, (epoch_ms(TIMESTAMP '2001-08-02') - epoch_ms(order_time)) / 86400000.0::DOUBLE AS age_days FROM f_orders)
SELECT order_id, age_days, CASE WHEN age_days > 14 THEN '>14' WHEN age_days > 7 THEN '>7' WHEN age_days > 3 THEN '>3'
       WHEN age_days > 1 THEN '>1' ELSE 'today' END AS age_class FROM a""", num="age_days")
def _(spark, sf):
    age = X.age_days(F.lit("2001-08-02 00:00:00").cast("timestamp_ntz"), "order_time")
    return src.orders(spark, sf).select("order_id", age.alias("age_days"), X.age_class(age).alias("age_class"))


@query("milestone_seconds", using("f_orders") + """
SELECT order_id, date_diff('second', order_time, pay_time) AS pay_sec,
       greatest(order_time, pay_time, shipping_time, complete_time, cancel_time) AS latest
FROM f_orders""", ts="latest")
def _(spark, sf):
    return src.orders(spark, sf).select(
        "order_id", X.seconds_between("order_time", "pay_time").alias("pay_sec"),
        X.latest_milestone("order_time", "pay_time", "shipping_time", "complete_time", "cancel_time").alias("latest"))


@query("date_parts", """
SELECT o_orderkey AS order_id, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, month(o_orderdate) AS month,
       weekofyear(o_orderdate) AS iso_week, isodow(o_orderdate) AS day_of_week,
       CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM "orders" """, whole="is_weekend")
def _(spark, sf):
    return src.orders(spark, sf).select("order_id", *[c.alias(n) for n, c in X.date_parts("order_time").items()])


@query("valid_phone", using("users") + """
SELECT user_id, phone, CASE WHEN regexp_full_match(phone, '1[35789][0-9]{9}') THEN 1 ELSE 0 END AS valid FROM users""",
       whole="valid")
def _(spark, sf):
    return src.users(spark, sf).select("user_id", "phone", X.is_valid_phone("phone").alias("valid"))


@query("labels_padded", """
SELECT p_partkey AS product_id, 'P' || CASE WHEN length(p_partkey::VARCHAR) >= 3 THEN p_partkey::VARCHAR
       ELSE lpad(p_partkey::VARCHAR, 3, '0') END AS label FROM part""")
def _(spark, sf):
    return src.products(spark, sf).select("product_id", X.label("P", "product_id", 3).alias("label"))


@query("latency_ms", using("probes") + "SELECT id, ms AS latency FROM probes")
def _(spark, sf):
    return src.probes(spark, sf).select("id", X.latency_ms("sink_time", "create_time_ms").alias("latency"))


@query("if_null", using("f_orders") + "SELECT order_id, coalesce(cancel_time, TIMESTAMP '1970-01-01') AS cancel_time FROM f_orders",
       ts="cancel_time")
def _(spark, sf):
    never = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return src.orders(spark, sf).select("order_id", X.if_null("cancel_time", never).alias("cancel_time"))


@query("field_escape", r"""
SELECT doc_id, md5(replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(13), '\r'), chr(10), '\n')) AS escaped,
       md5(text) AS restored FROM documents""")
def _(spark, sf):
    """Whole texts through escape and back; hashes keep the result small."""
    escaped = escape_field(F.col("text"))
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", F.md5(escaped).alias("escaped"), F.md5(unescape_field(escaped)).alias("restored"))
