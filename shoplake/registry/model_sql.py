"""SQL form of the test-table adapters, for the check queries."""

from __future__ import annotations

_PARTS = {
    "users": """
  SELECT c_custkey AS user_id, c_name AS username,
         '1' || CAST(c_custkey % 10 AS VARCHAR) || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS phone,
         r_name AS province, n_name AS city, c_custkey % 3 + 1 AS user_level,
         CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END AS status, c_mktsegment AS register_channel,
         0 AS is_deleted, TIMESTAMP '1994-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS update_time
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "products": """
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS brand,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price,
         CAST(round(CAST(p_retailprice AS DECIMAL(10,2)) * 0.70, 2) AS DECIMAL(10,2)) AS cost_price,
         CAST(p_size AS INTEGER) AS stock, CASE WHEN p_size % 10 = 0 THEN 0 ELSE 1 END AS status,
         0 AS is_deleted, TIMESTAMP '1994-01-01' + to_days(CAST(p_partkey % 365 AS INTEGER)) AS update_time
  FROM part""",
    "orders0": """
  SELECT o_orderkey AS order_id, o_custkey AS user_id,
         CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED'
              WHEN o_orderstatus = 'P' THEN CASE WHEN left(o_orderpriority, 1) IN ('1','2') THEN 'SHIPPED' ELSE 'PAID' END
              WHEN left(o_orderpriority, 1) = '5' THEN 'CANCELLED' ELSE 'CREATED' END AS order_status,
         o_orderkey % 7 + 1 AS item_count, CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount,
         CASE WHEN left(o_orderpriority, 1) = '1'
              THEN CAST(round(CAST(o_totalprice AS DECIMAL(12,2)) * 0.05, 2) AS DECIMAL(12,2))
              ELSE CAST(0 AS DECIMAL(12,2)) END AS discount_amount,
         o_orderdate AS order_time,
         o_orderdate + to_hours(o_orderkey % 48 + 1) AS t1,
         o_orderdate + to_hours(o_orderkey % 48 + 1 + o_orderkey % 96 + 2) AS t2,
         o_orderdate + to_hours(o_orderkey % 48 + 1 + o_orderkey % 96 + 2 + o_orderkey % 120 + 12) AS t3,
         o_orderdate + to_hours(o_orderkey % 24 + 1) AS t4
  FROM "orders" """,
    "f_orders": """
  SELECT order_id, user_id, order_status, item_count, total_amount, discount_amount, order_time,
         CASE WHEN order_status IN ('PAID','SHIPPED','COMPLETED') THEN t1 END AS pay_time,
         CASE WHEN order_status IN ('SHIPPED','COMPLETED') THEN t2 END AS shipping_time,
         CASE WHEN order_status = 'COMPLETED' THEN t3 END AS complete_time,
         CASE WHEN order_status = 'CANCELLED' THEN t4 END AS cancel_time,
         CASE order_status WHEN 'COMPLETED' THEN t3 WHEN 'SHIPPED' THEN t2 WHEN 'PAID' THEN t1
              WHEN 'CANCELLED' THEN t4 ELSE order_time END AS update_time,
         CASE WHEN order_status = 'CANCELLED' AND order_id % 3 = 0 THEN 1 ELSE 0 END AS is_deleted,
         CASE WHEN order_status = 'CANCELLED' AND order_id % 3 = 0 THEN t4 + to_hours(24) END AS deleted_time,
         CAST(order_time AS DATE) AS dt
  FROM orders0""",
    "lines0": """
  SELECT l_orderkey * 10 + l_linenumber AS item_id, l_orderkey AS order_id, l_partkey AS product_id,
         CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS subtotal,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS cents,
         CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(12,2)) AS discount_amount,
         l_shipdate AS create_time
  FROM lineitem""",
    "f_items": """
  SELECT item_id, order_id, product_id, quantity,
         CAST(CAST((cents * 2 + quantity) // (quantity * 2) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(10,2)) AS unit_price,
         subtotal, discount_amount, create_time, CAST(create_time AS DATE) AS dt
  FROM lines0""",
    "d_items": """
  SELECT i.*, category, brand, price AS current_price, cost_price, i.subtotal - i.discount_amount AS net_amount,
         i.quantity * price AS current_price_amount,
         i.subtotal - i.discount_amount - i.quantity * cost_price AS gross_margin
  FROM f_items i LEFT JOIN products p ON i.product_id = p.product_id""",
    "user_day": """
  SELECT user_id, dt, count(*) AS order_cnt, sum(total_amount) AS order_amt, count(pay_time) AS paid_cnt,
         sum(CASE WHEN pay_time IS NOT NULL THEN total_amount ELSE 0 END) AS paid_amt,
         count(shipping_time) AS shipped_cnt, count(complete_time) AS completed_cnt,
         count(cancel_time) AS cancelled_cnt, sum(discount_amount) AS discount_amt
  FROM f_orders GROUP BY user_id, dt""",
    "product_day": """
  SELECT product_id, dt, count(*) AS line_cnt, sum(quantity) AS qty, sum(subtotal) AS gross_amt,
         sum(discount_amount) AS discount_amt, sum(net_amount) AS net_amt,
         sum(current_price_amount) AS current_price_amt
  FROM d_items GROUP BY product_id, dt""",
    "category_day": """
  SELECT category, dt, count(*) AS line_cnt, sum(quantity) AS qty, sum(subtotal) AS gross_amt,
         sum(discount_amount) AS discount_amt, sum(net_amount) AS net_amt,
         sum(current_price_amount) AS current_price_amt, count(DISTINCT order_id) AS order_cnt
  FROM d_items GROUP BY category, dt""",
    "lifetime": """
  SELECT user_id, min(order_time) AS first_order_time, max(order_time) AS last_order_time,
         count(*) AS order_cnt, count(pay_time) AS paid_cnt,
         sum(CASE WHEN pay_time IS NOT NULL THEN total_amount ELSE 0 END) AS paid_amt,
         count(cancel_time) AS cancelled_cnt
  FROM f_orders GROUP BY user_id""",
    "price_log": """
  SELECT event_id AS change_id, user_id AS product_id, CAST(value AS DECIMAL(10,2)) AS new_price,
         CASE event_type WHEN 'purchase' THEN 'ADJUST' WHEN 'error' THEN 'OFFSHELF' ELSE 'FINAL' END AS change_type,
         ts AS change_time
  FROM events WHERE event_type IN ('purchase','signup','error')""",
    "stock_log": """
  SELECT event_id AS change_id, user_id AS product_id,
         CASE event_type WHEN 'click' THEN 'ORDER_DEDUCT' ELSE 'REPLENISH' END AS change_type,
         CAST(CASE event_type WHEN 'click' THEN -floor(value) ELSE floor(value) END AS INTEGER) AS delta,
         event_id * 37 % 500 AS stock_after, ts AS change_time
  FROM events WHERE event_type IN ('purchase','click')""",
    "status_log": """
  SELECT user_id AS order_id, event_id AS seq,
         CASE event_type WHEN 'view' THEN 'CREATED' WHEN 'click' THEN 'PAID' WHEN 'purchase' THEN 'SHIPPED'
              WHEN 'signup' THEN 'COMPLETED' WHEN 'error' THEN 'CANCELLED' END AS status, ts
  FROM events""",
    "probes": """
  SELECT event_id AS id, (epoch_us(ts) // 1000) AS create_time_ms, ts AS create_time,
         (epoch_us(ts) // 1000) + event_id * 37 % 1000 AS sink_ms, event_id * 37 % 1000 AS ms
  FROM events""",
    "arrivals": """
  SELECT event_id, user_id, event_type, ts, event_id + CASE WHEN event_id % 50 = 0 THEN 300 ELSE 0 END AS arrival
  FROM events""",
    "user_changes": """
  SELECT user_id, event_type AS last_event, CAST(value AS DECIMAL(12,2)) AS amount, ts AS update_time,
         CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' ELSE 'UA' END AS op, event_id AS seq
  FROM events""",
    "real_log": """
  SELECT * FROM price_log WHERE change_type <> 'FINAL'""",
    "moves": """
  SELECT *, lag(new_price) OVER w AS prev_price, lag(change_id) OVER w AS prev_id
  FROM (SELECT * FROM real_log QUALIFY row_number() OVER
        (PARTITION BY product_id, change_time ORDER BY change_id DESC) = 1) AS one_per_instant
  WINDOW w AS (PARTITION BY product_id ORDER BY change_time, change_id)""",
    "scd2": """
  SELECT product_id, new_price AS price, change_time AS price_start_time,
         lead(change_time) OVER w AS price_end_time,
         CASE WHEN lead(change_time) OVER w IS NULL THEN 1 ELSE 0 END AS is_current,
         row_number() OVER w AS version_no
  FROM moves WHERE prev_id IS NULL OR prev_price <> new_price
  WINDOW w AS (PARTITION BY product_id ORDER BY change_time, change_id)""",
}

_NEEDS = {
    "f_orders": ["orders0"], "f_items": ["lines0"], "d_items": ["f_items", "products"],
    "user_day": ["f_orders"], "product_day": ["d_items"], "category_day": ["d_items"],
    "lifetime": ["f_orders"], "real_log": ["price_log"], "moves": ["real_log"], "scd2": ["moves"],
}


def using(*names: str) -> str:
    """A WITH clause for the named tables and what they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({_PARTS[n]})" for n in ordered) + "\n"
