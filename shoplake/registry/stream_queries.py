"""Streaming jobs, run over everything available and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplake.operators.filters import exclude_types
from shoplake.operators.changes import latest_per_key
from shoplake.plans import dwd
from shoplake.registry.base import query
from shoplake.registry.detail_queries import ACC_COLUMNS, STEP_OK
from shoplake.registry.model_sql import using
from shoplake.registry.source_queries import UPSERTED
from shoplake.session import scratch_dir
from shoplake.sources import driver_tables as src
from shoplake.sources.keyed import KeyedTable
from shoplake.sources.lake import read_changelog
from shoplake.streaming import runs, tables, windows

BATCHES = 4
FILE_ROWS = 250_000


def feed(spark, df, order, root):
    """A stream over `df`, a quarter of the rows per micro-batch in `order`.

    A micro-batch has at least two files and as many as its rows need.
    """
    chunk = max(1, -(-df.count() // BATCHES))
    files = min(chunk, max(2, -(-chunk // FILE_ROWS)))
    runs.stage_in_order(df, root, order, chunk, files)
    return runs.replay_stream(spark, root, df.schema, files)


def raw_stream(spark, sf, name):
    """A stream over one test table."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return read_changelog(spark, sf, schema, streaming=True, glob=f"{name}.parquet")


@query("stream_upsert", UPSERTED, num="amount", ts="update_time")
def _(spark, sf):
    """Upserts and deletes in an order unlike the source's."""
    root = scratch_dir(spark, "upsert")
    changes = src.user_changes(spark, sf).withColumn("arrival", F.xxhash64("seq"))
    stream = feed(spark, changes, ["arrival", "seq"], root).drop("arrival")
    table = KeyedTable(f"{root}/table", stream.schema, ["user_id"], ["seq"])
    tables.upsert_stream(stream, table, f"{root}/checkpoint")
    return table.current(spark)


@query("stream_scd2", using("scd2") + "SELECT * FROM scd2", num="price", ts="price_start_time price_end_time",
       whole="is_current")
def _(spark, sf):
    """Changes arrive out of order across batches; late ones split older versions."""
    root = scratch_dir(spark, "scd2")
    log = exclude_types(src.price_log(spark, sf), ["FINAL"]).withColumn("arrival", F.xxhash64("change_id"))
    stream = feed(spark, log, ["arrival", "change_id"], root).drop("arrival")
    tables.scd2_stream(stream, f"{root}/scd2", f"{root}/checkpoint")
    return tables.scd2_versions(spark, f"{root}/scd2")


@query("stream_order_acc", using("status_log") + """
, m AS (SELECT order_id, min(ts) FILTER (status = 'CREATED') AS order_time, min(ts) FILTER (status = 'PAID') AS pay_time,
               min(ts) FILTER (status = 'SHIPPED') AS shipping_time, min(ts) FILTER (status = 'COMPLETED') AS complete_time,
               min(ts) FILTER (status = 'CANCELLED') AS cancel_time FROM status_log GROUP BY order_id)
SELECT *, datesub('second', order_time, pay_time) AS pay_sec, datesub('second', pay_time, shipping_time) AS ship_sec,
       datesub('second', shipping_time, complete_time) AS complete_sec FROM m""",
       ts="order_time pay_time shipping_time complete_time cancel_time")
def _(spark, sf):
    root = scratch_dir(spark, "acc")
    stream = feed(spark, src.status_log(spark, sf), ["seq"], root)
    tables.acc_stream(stream, f"{root}/acc", f"{root}/checkpoint")
    return tables.acc_snapshot(spark, f"{root}/acc")


@query("stream_lookup", using("d_items") + "SELECT item_id, product_id, category, brand FROM d_items")
def _(spark, sf):
    root = scratch_dir(spark, "lookup")
    raw = raw_stream(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), F.col("l_partkey").alias("product_id"))
    runs.append_sink(tables.lookup_stream(raw, src.products(spark, sf), ["category", "brand"]),
                     f"{root}/items", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/items").select("item_id", "product_id", "category", "brand")


@query("stream_windows", """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS rows
FROM events GROUP BY 1, 2""", ts="window_start window_end")
def _(spark, sf):
    """Hourly counts; the watermark leaves room for the late rows, so none is dropped."""
    root = scratch_dir(spark, "windows")
    stream = feed(spark, src.arrivals(spark, sf), ["arrival", "event_id"], root)
    table = windows.window_table(f"{root}/table")
    windows.window_stream(stream, "ts", "1 hour", "30 days", table, f"{root}/checkpoint")
    return table.current(spark)


@query("stream_late_rows", """
WITH a AS (SELECT event_id, ts, event_id + CASE WHEN event_id % 50 = 0 THEN (max(event_id) OVER ()) * 6 // 10 ELSE 0 END AS arrival FROM events),
n AS (SELECT *, (row_number() OVER (ORDER BY arrival, event_id) - 1) // CAST(ceil(count(*) OVER () / 4.0) AS BIGINT) AS batch FROM a),
m AS (SELECT batch, max(ts) AS latest FROM n GROUP BY 1),
w AS (SELECT batch, max(latest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 5 SECOND AS mark FROM m),
k AS (SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end
      FROM n JOIN w ON n.batch = w.batch WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark)
SELECT window_start, window_end, count(*) AS rows FROM k GROUP BY 1, 2""", ts="window_start window_end")
def _(spark, sf):
    """Every 50th event comes more than two batches late, past a 5-second watermark.

    A row is dropped when its window ended before the mark the last batch ran with.
    """
    root = scratch_dir(spark, "late")
    rows = src.events(spark, sf).select("event_id", "ts")
    behind = F.floor(rows.agg(F.max("event_id")).scalar() * 6 / 10)
    late = rows.withColumn("arrival", F.col("event_id") + F.when(F.col("event_id") % 50 == 0, behind).otherwise(0))
    stream = feed(spark, late, ["arrival", "event_id"], root)
    table = windows.window_table(f"{root}/table")
    windows.window_stream(stream, "ts", "1 hour", "5 seconds", table, f"{root}/checkpoint")
    return table.current(spark)


@query("split_late", using("arrivals") + """
, a AS (SELECT *, max(ts) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
        FROM (SELECT event_id, event_type, ts, arrival * 2 - CASE WHEN arrival = event_id THEN 0 ELSE 1 END AS arrival FROM arrivals))
SELECT event_id, event_type, CASE WHEN ts < seen - INTERVAL 60 SECOND THEN 1 ELSE 0 END AS late FROM a""", whole="late")
def _(spark, sf):
    rows = src.arrivals(spark, sf).withColumn(
        "arrival", F.col("arrival") * 2 - F.when(F.col("event_id") == F.col("arrival"), 0).otherwise(1))
    return windows.split_late(rows, "arrival", "ts", 60).select("event_id", "event_type", "late")


@query("stream_drop_repeats", "SELECT event_id, user_id, event_type FROM events")
def _(spark, sf):
    """Every third event is sent again 20 places later."""
    root = scratch_dir(spark, "repeats")
    once = src.events(spark, sf).select("event_id", "user_id", "event_type", "ts",
                                        (F.col("event_id") * 2).alias("arrival"))
    again = once.where("event_id % 3 = 0").withColumn("arrival", F.col("arrival") + 41)
    stream = feed(spark, once.unionByName(again), ["arrival"], root)
    runs.append_sink(windows.drop_repeats(stream, "event_id", "ts", "2 days"), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").select("event_id", "user_id", "event_type")


@query("window_rates", """
WITH w AS (SELECT date_trunc('hour', ts) AS window_start, count(*) AS rows FROM events GROUP BY 1),
p AS (SELECT *, sum(rows) OVER b AS s, count(rows) OVER b AS n FROM w
      WINDOW b AS (ORDER BY window_start ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT window_start, rows, round(CAST(rows AS DOUBLE) / 3600, 6) AS rate,
       round(CAST(rows AS DOUBLE) / 3600.0::DOUBLE / 0.004::DOUBLE, 6) AS of_target,
       CASE WHEN rows >= CAST(s AS DOUBLE) / nullif(n, 0) * 1.5 THEN 1 ELSE 0 END AS burst FROM p""",
       ts="window_start", whole="burst")
def _(spark, sf):
    return windows.window_rates(src.events(spark, sf), "ts", 3600, 0.004, 24, 1.5)


@query("stream_rates", """
WITH w AS (SELECT date_trunc('hour', ts) AS window_start, count(*) AS rows FROM events GROUP BY 1),
p AS (SELECT *, sum(rows) OVER b AS s, count(rows) OVER b AS n FROM w
      WINDOW b AS (ORDER BY window_start ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT window_start, rows, round(CAST(rows AS DOUBLE) / 3600, 6) AS rate,
       round(CAST(rows AS DOUBLE) / 3600.0::DOUBLE / 0.004::DOUBLE, 6) AS of_target,
       CASE WHEN rows >= CAST(s AS DOUBLE) / nullif(n, 0) * 1.5 THEN 1 ELSE 0 END AS burst FROM p""",
       ts="window_start", whole="burst")
def _(spark, sf):
    """Rates and bursts of the hourly counts a stream keeps, rows arriving out of order."""
    root = scratch_dir(spark, "rates")
    stream = feed(spark, src.arrivals(spark, sf), ["arrival", "event_id"], root)
    table = windows.window_table(f"{root}/table")
    windows.window_stream(stream, "ts", "1 hour", "30 days", table, f"{root}/checkpoint")
    return windows.rates(table.current(spark), 3600, 0.004, 24, 1.5)


@query("stream_price_log", using("price_log") + """
SELECT change_id, product_id, new_price, change_type, change_time FROM price_log""", num="new_price", ts="change_time")
def _(spark, sf):
    """Append-only; rows are never changed."""
    root = scratch_dir(spark, "price-log")
    log = src.price_log(spark, sf).select("change_id", "product_id", "new_price", "change_type", "change_time")
    runs.append_sink(feed(spark, log, ["change_id"], root), f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(log.schema).parquet(f"{root}/out")


@query("stream_stock_log", using("stock_log") + """
SELECT change_id, product_id, change_type, delta, stock_after, change_time FROM stock_log""",
       ts="change_time", whole="delta stock_after")
def _(spark, sf):
    root = scratch_dir(spark, "stock-log")
    log = src.stock_log(spark, sf).drop("order_id")
    runs.append_sink(feed(spark, log, ["change_id"], root), f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(log.schema).parquet(f"{root}/out")


@query("stream_sink_stamp", "SELECT event_id, 1 AS stamped FROM events", whole="stamped")
def _(spark, sf):
    root = scratch_dir(spark, "stamp")
    stream = raw_stream(spark, sf, "events").select("event_id", F.col("ts").alias("create_time"))
    tables.stamp_sink_time(stream, f"{root}/out", f"{root}/checkpoint")
    stamped = spark.read.parquet(f"{root}/out")
    return stamped.select("event_id", F.when(F.col("sink_time") > F.col("create_time"), 1).otherwise(0).alias("stamped"))


@query("backfill_then_follow", UPSERTED, num="amount", ts="update_time")
def _(spark, sf):
    """A snapshot of the first half, then the whole stream from its start."""
    root = scratch_dir(spark, "backfill")
    changes = src.user_changes(spark, sf)
    middle = changes.agg(F.floor(F.max("seq") / 2)).scalar()
    snapshot = latest_per_key(changes.where(F.col("seq") <= middle), ["user_id"], ["seq"])
    stream = feed(spark, changes, ["seq"], root)
    table = KeyedTable(f"{root}/table", changes.schema, ["user_id"], ["seq"])
    tables.backfill_then_follow(spark, snapshot, stream, table, f"{root}/checkpoint")
    return table.current(spark)


@query("stream_replay_order", """
WITH c AS (SELECT event_id, CAST(ceil(count(*) OVER () / 4.0) AS BIGINT) AS per,
                  row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT pos // per AS batch_id, count(*) AS rows, min(event_id) AS first_id, max(event_id) AS last_id FROM c GROUP BY 1""")
def _(spark, sf):
    """Each micro-batch holds exactly the next chunk of the order."""
    root = scratch_dir(spark, "replay")
    stream = feed(spark, src.events(spark, sf), ["ts", "event_id"], root)

    def note(batch, batch_id, run):
        batch.agg(F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first_id"),
                  F.max("event_id").alias("last_id")) \
            .write.mode("overwrite").parquet(f"{root}/notes/batch_id={batch_id}")

    runs.each_batch(stream, note, f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/notes").withColumn("batch_id", F.col("batch_id").cast("bigint"))


@query("stream_dim_date", """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS date_key, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter,
       month(o_orderdate) AS month, weekofyear(o_orderdate) AS iso_week, isodow(o_orderdate) AS day_of_week,
       CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM "orders" """,
       day="date_key", whole="is_weekend")
def _(spark, sf):
    root = scratch_dir(spark, "dim-date")
    tables.date_dim_stream(raw_stream(spark, sf, "orders"), "o_orderdate", f"{root}/table", f"{root}/checkpoint")
    return tables.date_dim_table(f"{root}/table").current(spark)


@query("stream_dim_product", using("products") + """
, e AS (SELECT user_id AS product_id, event_id AS seq, CAST(value AS DECIMAL(10,2)) AS price FROM events WHERE event_type = 'purchase'),
l AS (SELECT product_id, arg_max(price, seq) AS new_price FROM e GROUP BY 1)
SELECT p.product_id, product_name, category, coalesce(new_price, price) AS price
FROM products p LEFT JOIN l ON p.product_id = l.product_id""", num="price")
def _(spark, sf):
    """All products first, then price updates of some of them."""
    root = scratch_dir(spark, "dim-product")
    base = src.products(spark, sf)
    loaded = base.withColumns({"op": F.lit("I"), "seq": F.lit(-1).cast("bigint"), "arrival": F.lit(-1).cast("bigint")})
    moved = src.events(spark, sf).where("event_type = 'purchase'").select(
        F.col("user_id").alias("product_id"), F.col("event_id").alias("seq"), F.col("value").cast("decimal(10,2)").alias("_p"))
    updates = base.join(moved, "product_id").withColumns(
        {"price": F.col("_p"), "op": F.lit("UA"), "arrival": F.col("seq")}).select(*loaded.columns)
    stream = feed(spark, loaded.unionByName(updates), ["arrival", "product_id"], root)
    tables.dim_stream(stream, "dim_product", f"{root}/table", f"{root}/checkpoint")
    return tables.dim_table("dim_product", f"{root}/table").current(spark).select(
        "product_id", "product_name", "category", "price")


@query("stream_dim_user", using("users") + """
, l AS (SELECT user_id, arg_max(event_type, event_id) AS last_event FROM events
        WHERE event_type IN ('click','purchase','error') GROUP BY 1)
SELECT u.user_id, username, province, coalesce(last_event, register_channel) AS register_channel
FROM users u LEFT JOIN l ON u.user_id = l.user_id WHERE last_event IS DISTINCT FROM 'error'""")
def _(spark, sf):
    """All users first, then changes of some of them; an error event closes the user until the next change."""
    root = scratch_dir(spark, "dim-user")
    base = src.users(spark, sf)
    loaded = base.withColumns({"op": F.lit("I"), "seq": F.lit(-1).cast("bigint"), "arrival": F.lit(-1).cast("bigint")})
    moved = src.events(spark, sf).where("event_type in ('click', 'purchase', 'error')").select(
        "user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("_event"))
    updates = base.join(moved, "user_id").withColumns(
        {"register_channel": F.col("_event"), "op": F.when(F.col("_event") == "error", "D").otherwise("UA"),
         "arrival": F.col("seq")}).select(*loaded.columns)
    stream = feed(spark, loaded.unionByName(updates), ["arrival", "user_id"], root)
    tables.dim_stream(stream, "dim_user", f"{root}/table", f"{root}/checkpoint")
    return tables.dim_table("dim_user", f"{root}/table").current(spark).select(
        "user_id", "username", "province", "register_channel")


@query("stream_fact_order_item", using("f_items") + """
SELECT item_id, order_id, product_id, quantity, subtotal, discount_amount, CAST(date_trunc('month', create_time) AS DATE) AS order_month
FROM f_items QUALIFY row_number() OVER (PARTITION BY item_id, date_trunc('month', create_time)
                                        ORDER BY subtotal DESC, discount_amount DESC, product_id DESC, quantity DESC) = 1""", num="subtotal discount_amount", day="order_month", whole="quantity")
def _(spark, sf):
    """Lines arrive twice, a first version after the last one; the table is laid out by month.

    The test tables repeat some line ids, so the row's own columns break ties of `seq`.
    """
    root = scratch_dir(spark, "lines")
    lines = src.items(spark, sf).withColumn("order_month", F.trunc("create_time", "month"))
    new = lines.withColumns({"op": F.lit("UA"), "seq": F.lit(2).cast("bigint"), "arrival": F.col("item_id")})
    old = lines.withColumns({"quantity": F.lit(0), "op": F.lit("I"), "seq": F.lit(1).cast("bigint"),
                             "arrival": F.col("item_id") + 50_000})
    stream = feed(spark, new.unionByName(old), ["arrival", "seq"], root).drop("arrival")
    table = KeyedTable(f"{root}/table", stream.schema, ["order_month", "item_id"],
                       ["seq", "subtotal", "discount_amount", "product_id", "quantity"], ("order_month",))
    tables.upsert_stream(stream, table, f"{root}/checkpoint")
    return table.current(spark).select("item_id", "order_id", "product_id", "quantity", "subtotal", "discount_amount",
                                       "order_month")


@query("stream_fact_order", using("f_orders") + f"SELECT {ACC_COLUMNS} FROM f_orders",
       num="total_amount discount_amount", whole="is_deleted",
       ts="order_time pay_time shipping_time complete_time cancel_time")
def _(spark, sf):
    """Order rows arrive twice, the old state after the new one; the snapshot keeps the new."""
    root = scratch_dir(spark, "orders")
    orders = src.orders(spark, sf)
    new = orders.withColumns({"op": F.lit("UA"), "seq": F.lit(2).cast("bigint"), "arrival": F.col("order_id")})
    old = orders.withColumns({
        "order_status": F.lit("CREATED"), "op": F.lit("I"), "seq": F.lit(1).cast("bigint"),
        "arrival": F.col("order_id") + 5000,
        **{c: F.lit(None).cast("timestamp_ntz") for c in ("pay_time", "shipping_time", "complete_time", "cancel_time")}})
    stream = feed(spark, new.unionByName(old), ["arrival", "seq"], root)
    tables.dim_stream(stream, "fact_order", f"{root}/table", f"{root}/checkpoint")
    current = tables.dim_table("fact_order", f"{root}/table").current(spark)
    return dwd.fact_order_acc(current).drop("dt", "pay_sec", "ship_sec", "complete_sec")


@query("stream_invalid_steps", using("status_log") + f"""
, s AS (SELECT order_id, seq, status AS to_status, lag(status) OVER (PARTITION BY order_id ORDER BY seq) AS from_status
        FROM status_log)
SELECT * FROM s WHERE NOT ({STEP_OK})""")
def _(spark, sf):
    root = scratch_dir(spark, "steps")
    stream = feed(spark, src.status_log(spark, sf), ["seq"], root)
    tables.invalid_transition_stream(stream, root, f"{root}/checkpoint")
    return tables.invalid_transitions(spark, root)
