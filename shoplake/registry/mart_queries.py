"""Summary and report tables, from the raw tables up."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplake.plans import ads, dwd, dws
from shoplake.operators.aggregates import ratio_of_sums
from shoplake.operators.status import flag_new_customer
from shoplake.registry.base import query
from shoplake.registry.model_sql import using
from shoplake.sources import driver_tables as src
from shoplake.sources.lake import load_table
from shoplake.session import scratch_dir

DAY_SUMS = "order_amt paid_amt discount_amt"
LINE_SUMS = "gross_amt discount_amt net_amt current_price_amt"


def acc(spark, sf):
    return dwd.fact_order_acc(src.orders(spark, sf))


def lines(spark, sf):
    return dwd.fact_order_item(src.items(spark, sf), src.products(spark, sf))


def user_day(spark, sf):
    return dws.trade_user_day(acc(spark, sf))


def product_day(spark, sf):
    return dws.product_day_from_lines(src.items(spark, sf), src.products(spark, sf))


def category_sums(spark, sf):
    """For reports that do not show the count of orders."""
    return dws.category_day_sums(lines(spark, sf))


@query("dws_trade_user_day", using("user_day") + "SELECT * FROM user_day", num=DAY_SUMS, day="dt")
def _(spark, sf):
    return user_day(spark, sf)


@query("dws_trade_product_day", using("product_day") + "SELECT * FROM product_day",
       num=LINE_SUMS, day="dt", whole="qty")
def _(spark, sf):
    return product_day(spark, sf)


@query("dws_trade_category_day", using("category_day") + "SELECT * FROM category_day",
       num=LINE_SUMS, day="dt", whole="qty")
def _(spark, sf):
    return dws.trade_category_day(lines(spark, sf))


@query("dws_trade_province_day", using("f_orders", "users") + """
SELECT province, dt, count(DISTINCT o.user_id) AS buyer_cnt, count(*) AS order_cnt, sum(total_amount) AS order_amt,
       sum(CASE WHEN pay_time IS NOT NULL THEN total_amount ELSE 0 END) AS paid_amt
FROM f_orders o LEFT JOIN users u ON o.user_id = u.user_id GROUP BY province, dt""",
       num="order_amt paid_amt", day="dt")
def _(spark, sf):
    return dws.trade_province_day(user_day(spark, sf), src.users(spark, sf))


@query("dws_user_lifetime", using("lifetime") + "SELECT * FROM lifetime", num="paid_amt",
       ts="first_order_time last_order_time")
def _(spark, sf):
    return dws.user_lifetime(acc(spark, sf))


OVERVIEW = """
SELECT dt, count(DISTINCT user_id) AS buyers, count(*) AS orders, sum(total_amount) AS order_amt,
       sum(CASE WHEN pay_time IS NOT NULL THEN total_amount ELSE 0 END) AS paid_amt,
       floor(CAST(sum(total_amount) AS DOUBLE) / count(*) * 1000000 + 0.5) / 1000000 AS avg_order_value, -- half up
       round(CAST(count(pay_time) AS DOUBLE) / count(*), 6) AS pay_rate,
       round(CAST(count(cancel_time) AS DOUBLE) / count(*), 6) AS cancel_rate
FROM f_orders GROUP BY dt"""


@query("ads_trade_overview_day", using("f_orders") + OVERVIEW, num="order_amt paid_amt", day="dt")
def _(spark, sf):
    return ads.trade_overview_day(user_day(spark, sf))


@query("ads_order_funnel_day", using("f_orders") + """
SELECT dt, count(*) AS ordered, count(pay_time) AS paid, count(shipping_time) AS shipped,
       count(complete_time) AS completed,
       round(CAST(count(pay_time) AS DOUBLE) / count(*), 6) AS pay_rate,
       round(CAST(count(shipping_time) AS DOUBLE) / nullif(count(pay_time), 0), 6) AS ship_rate,
       round(CAST(count(complete_time) AS DOUBLE) / nullif(count(shipping_time), 0), 6) AS complete_rate
FROM f_orders GROUP BY dt""", day="dt")
def _(spark, sf):
    return ads.order_funnel_day(user_day(spark, sf))


RANKED = """
SELECT dt, category, net_amt, rank() OVER (PARTITION BY dt ORDER BY net_amt DESC) AS rank,
       round(CAST(net_amt AS DOUBLE) / CAST(sum(net_amt) OVER (PARTITION BY dt) AS DOUBLE), 6) AS share
FROM category_day"""


@query("ads_category_rank_day", using("category_day") + RANKED, num="net_amt", day="dt")
def _(spark, sf):
    return ads.category_rank_day(category_sums(spark, sf))


@query("top_k_categories", using("category_day") + f"""
SELECT * FROM ({RANKED}) r WHERE dt = DATE '1998-06-15' AND rank <= 3""", num="net_amt", day="dt")
def _(spark, sf):
    return ads.top_k_categories(category_sums(spark, sf), "1998-06-15", 3)


@query("ads_user_rfm", using("lifetime") + """
, base AS (SELECT user_id, date_diff('day', CAST(last_order_time AS DATE), DATE '2001-08-02') AS recency_days,
                  order_cnt AS frequency, paid_amt AS monetary FROM lifetime),
scored AS (SELECT *, 6 - ntile(5) OVER (ORDER BY recency_days, user_id) AS r_score,
                  ntile(5) OVER (ORDER BY frequency, user_id) AS f_score,
                  ntile(5) OVER (ORDER BY monetary, user_id) AS m_score FROM base)
SELECT *, CASE WHEN m_score >= 4 THEN 'important' ELSE 'general' END || ' ' ||
          CASE WHEN r_score >= 4 AND f_score >= 4 THEN 'value' WHEN f_score >= 4 THEN 'keep'
               WHEN r_score >= 4 THEN 'develop' ELSE 'retain' END AS segment
FROM scored""", num="monetary", whole="r_score f_score m_score")
def _(spark, sf):
    return ads.user_rfm(dws.user_lifetime(acc(spark, sf)), "2001-08-02")


@query("ads_gmv_caliber_compare", using("product_day", "user_day") + """
, a AS (SELECT dt, sum(gross_amt) AS gross_gmv, sum(net_amt) AS net_gmv FROM product_day GROUP BY dt),
b AS (SELECT dt, sum(paid_amt) AS paid_gmv FROM user_day GROUP BY dt)
SELECT coalesce(a.dt, b.dt) AS dt, gross_gmv, net_gmv, paid_gmv, gross_gmv - net_gmv AS gross_net_gap,
       net_gmv - paid_gmv AS net_paid_gap, gross_gmv - paid_gmv AS gross_paid_gap
FROM a FULL JOIN b ON a.dt = b.dt""",
       num="gross_gmv net_gmv paid_gmv gross_net_gap net_paid_gap gross_paid_gap", day="dt")
def _(spark, sf):
    return ads.gmv_caliber_compare(product_day(spark, sf), user_day(spark, sf))


@query("ads_price_divergence_by_category", using("d_items") + """
SELECT category, sum(subtotal) AS snapshot_amt, sum(current_price_amount) AS current_price_amt,
       sum(current_price_amount) - sum(subtotal) AS diff_amt,
       round(CAST(sum(current_price_amount) - sum(subtotal) AS DOUBLE) / CAST(sum(subtotal) AS DOUBLE), 6) AS diff_ratio
FROM d_items GROUP BY category""", num="snapshot_amt current_price_amt diff_amt")
def _(spark, sf):
    return ads.price_divergence_by_category(category_sums(spark, sf))


@query("materialised_preagg", using("f_orders") + OVERVIEW, num="order_amt paid_amt", day="dt")
def _(spark, sf):
    """The report from a stored summary; the check computes it from the orders."""
    path = scratch_dir(spark, "preagg")
    load_table(user_day(spark, sf), path)
    return ads.trade_overview_day(spark.read.parquet(path))


@query("ratio_of_sums", using("d_items") + """
SELECT category, brand, round(CAST(sum(gross_margin) AS DOUBLE) / CAST(sum(net_amount) AS DOUBLE), 6) AS margin_rate
FROM d_items GROUP BY category, brand""")
def _(spark, sf):
    return ratio_of_sums(lines(spark, sf), ["category", "brand"], "gross_margin", "net_amount", "margin_rate")


@query("new_customer_day", using("f_orders") + """
, first AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY order_time, order_id) AS rn FROM f_orders)
SELECT dt, sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) AS new_customers, count(*) AS orders FROM first GROUP BY dt""",
       day="dt", whole="new_customers")
def _(spark, sf):
    flagged = flag_new_customer(src.orders(spark, sf))
    return flagged.groupBy(F.to_date("order_time").alias("dt")).agg(
        F.sum("is_new_customer").alias("new_customers"), F.count(F.lit(1)).alias("orders"))
