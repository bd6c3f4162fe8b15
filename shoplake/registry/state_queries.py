"""Streams with keyed state, joined streams, chained windows and row counts, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplake.functions.scalars import cents_of, from_cents
from shoplake.operators.status import with_durations
from shoplake.registry.base import query
from shoplake.registry.detail_queries import STEP_OK
from shoplake.registry.model_sql import using
from shoplake.registry.stream_queries import feed
from shoplake.session import scratch_dir
from shoplake.sources import driver_tables as src
from shoplake.sources.lake import bucket_count
from shoplake.streaming import counts, joined, keyed_state, runs, windows


@query("stream_steps_in_state", using("status_log") + f"""
, s AS (SELECT order_id, seq, status AS to_status, lag(status) OVER (PARTITION BY order_id ORDER BY seq) AS from_status
        FROM status_log)
SELECT * FROM s WHERE NOT ({STEP_OK})""")
def _(spark, sf):
    """The last status of each order is kept in the state store; ended orders stay for 60 days."""
    root = scratch_dir(spark, "state-steps")
    stream = feed(spark, src.status_log(spark, sf), ["seq"], root)
    with keyed_state.rocksdb(spark):
        runs.append_sink(keyed_state.invalid_steps_in_state(stream, "60 days", 60 * 86_400), f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema("order_id long, seq long, from_status string, to_status string").parquet(f"{root}/out")


@query("stream_life_in_state", using("status_log") + """
, m AS (SELECT order_id, min(ts) FILTER (status = 'CREATED') AS order_time, min(ts) FILTER (status = 'PAID') AS pay_time,
               min(ts) FILTER (status = 'SHIPPED') AS shipping_time, min(ts) FILTER (status = 'COMPLETED') AS complete_time,
               min(ts) FILTER (status = 'CANCELLED') AS cancel_time FROM status_log GROUP BY order_id)
SELECT *, datesub('second', order_time, pay_time) AS pay_sec, datesub('second', pay_time, shipping_time) AS ship_sec,
       datesub('second', shipping_time, complete_time) AS complete_sec FROM m""",
       ts="order_time pay_time shipping_time complete_time cancel_time")
def _(spark, sf):
    """Milestones in the state store; ended orders leave it after a day and come back if a row follows."""
    root = scratch_dir(spark, "state-life")
    stream = feed(spark, src.status_log(spark, sf), ["seq"], root)
    with keyed_state.rocksdb(spark):
        runs.append_sink(keyed_state.milestones_in_state(stream, "1 day", 86_400), f"{root}/out", f"{root}/checkpoint")
    return with_durations(keyed_state.life_snapshot(spark.read.parquet(f"{root}/out")))


USER_DAY = {"order_amt": "total", "paid_cnt": "paid", "paid_amt": "paid * total", "shipped_cnt": "shipped",
            "completed_cnt": "completed", "cancelled_cnt": "cancelled", "discount_amt": "discount"}
ORDERS_PER_BUCKET = 4000


@query("stream_trade_user_day", using("f_orders") + """
SELECT user_id, dt, count(*) AS order_cnt, sum(total_amount) AS order_amt, count(pay_time) AS paid_cnt,
       coalesce(sum(total_amount) FILTER (pay_time IS NOT NULL), 0) AS paid_amt, count(shipping_time) AS shipped_cnt,
       count(complete_time) AS completed_cnt, count(cancel_time) AS cancelled_cnt, sum(discount_amount) AS discount_amt
FROM f_orders WHERE is_deleted = 0 GROUP BY user_id, dt""", num="order_amt paid_amt discount_amt", day="dt")
def _(spark, sf):
    """The user-day summary kept from order changes: each is taken away as it was and added as it is.

    Orders come as created, changed and perhaps deleted, in an order unlike the source's.
    """
    root = scratch_dir(spark, "signed-user-day")
    orders = src.orders(spark, sf).withColumn("dt", F.to_date("order_time").cast("string"))
    flags = {n: F.col(c).isNotNull().cast("int") for n, c in {
        "paid": "pay_time", "shipped": "shipping_time", "completed": "complete_time", "cancelled": "cancel_time"}.items()}
    rows = orders.select("order_id", "user_id", "dt", cents_of("total_amount").alias("total"),
                         cents_of("discount_amount").alias("discount"), *[c.alias(n) for n, c in flags.items()], "is_deleted")
    made = rows.withColumns({**{n: F.lit(0) for n in flags}, "op": F.lit("I"), "seq": F.lit(1).cast("bigint")})
    moved = rows.withColumns({"op": F.lit("UA"), "seq": F.lit(2).cast("bigint")})
    gone = rows.where("is_deleted = 1").withColumns({"op": F.lit("D"), "seq": F.lit(3).cast("bigint")})
    changes = made.unionByName(moved).unionByName(gone).drop("is_deleted").withColumn("arrival", F.xxhash64("order_id", "seq"))
    stream = feed(spark, changes, ["arrival"], root).drop("arrival")
    shape = {"user_id": "long", "dt": "string", "total": "long", "discount": "long", **{n: "int" for n in flags}}
    buckets = bucket_count(orders.count(), ORDERS_PER_BUCKET, least=32)
    with keyed_state.rocksdb(spark):
        keyed_state.keep_sums(keyed_state.signed_images(stream, "order_id", shape, buckets), ["user_id", "dt"], USER_DAY,
                              f"{root}/sums", f"{root}/checkpoint")
    kept = keyed_state.kept_sums(spark.read.parquet(f"{root}/sums"), ["user_id", "dt"], list(USER_DAY))
    money = {c: from_cents(F.col(c), "decimal(22,2)") for c in ("order_amt", "paid_amt", "discount_amt")}
    return kept.withColumnRenamed("rows", "order_cnt").withColumns(money)


@query("stream_trade_product_day", using("f_items") + """
SELECT product_id, dt, count(*) AS line_cnt, sum(quantity) AS qty, sum(subtotal) AS gross_amt, sum(discount_amount) AS discount_amt
FROM f_items WHERE item_id % 20 <> 0 GROUP BY product_id, dt""", num="gross_amt discount_amt", day="dt")
def _(spark, sf):
    """The product-day summary kept from a log with both images: no state at all. Every 20th line is deleted in the end."""
    root = scratch_dir(spark, "signed-product-day")
    lines = src.items(spark, sf).select("item_id", "product_id", F.to_date("create_time").alias("dt"), "quantity",
                                        cents_of("subtotal").alias("gross"), cents_of("discount_amount").alias("discount"))
    first = [F.col("quantity") + 1, F.col("gross") * 2]
    last = [F.col("quantity"), F.col("gross")]
    images = [("I", 0, first), ("UB", 1, first), ("UA", 1, last), ("D", 2, last)]
    # the images of a line are made side by side: the log is one pass over the lines, and a task sums them up at once
    made = F.array(*[F.struct(F.lit(op).alias("op"), F.lit(step).alias("step"), q.alias("quantity"), g.alias("gross"))
                     for op, step, (q, g) in images])
    log = lines.select("item_id", "product_id", "dt", "discount", F.inline(made)).where("op <> 'D' or item_id % 20 = 0")
    stream = feed(spark, log.withColumn("arrival", F.col("item_id") + 5000 * F.col("step")), ["arrival", "step", "op"], root)
    sums = {"qty": "quantity", "gross_amt": "gross", "discount_amt": "discount"}
    keyed_state.keep_sums(keyed_state.signs_of(stream), ["product_id", "dt"], sums, f"{root}/sums", f"{root}/checkpoint")
    kept = keyed_state.kept_sums(spark.read.parquet(f"{root}/sums"), ["product_id", "dt"], list(sums))
    return kept.withColumnRenamed("rows", "line_cnt").withColumns(
        {c: from_cents(F.col(c), "decimal(22,2)") for c in ("gross_amt", "discount_amt")})


def with_end(df, **last):
    """`df` and one row after all others that lets the watermark pass them."""
    end = df.agg(*[F.max(c).alias(c) for c in df.columns]).where(" and ".join(f"{c} is not null" for c in last))
    return df.unionByName(end.select(*[last[c].cast(t).alias(c) if c in last else F.lit(None).cast(t).alias(c) for c, t in df.dtypes]))


@query("stream_orders_with_lines", using("f_orders", "f_items") + """
, o AS (SELECT order_id, user_id FROM f_orders WHERE order_id % 10 <> 3), i AS (SELECT * FROM f_items WHERE order_id % 10 <> 4)
SELECT o.order_id, o.user_id AS order_user_id, item_id, i.order_id AS line_order_id, quantity
FROM o FULL JOIN i ON o.order_id = i.order_id""", whole="quantity")
def _(spark, sf):
    """Orders and lines as two streams, each out of order; some orders lack lines and some lines an order."""
    root = scratch_dir(spark, "two-streams")
    day = 86_400        # a watermark starts at second 0, so no row may be sent then
    sent = F.timestamp_seconds(F.col("order_id") + day).cast("timestamp_ntz")
    orders = src.orders(spark, sf).where("order_id % 10 <> 3").select("order_id", "user_id", sent.alias("sent"))
    lines = src.items(spark, sf).where("order_id % 10 <> 4").select("order_id", "item_id", "quantity", F.timestamp_seconds(
        F.col("order_id") + day + F.pmod(F.xxhash64("item_id", "quantity"), F.lit(600))).cast("timestamp_ntz").alias("sent"))
    late = F.unix_seconds(F.col("sent").cast("timestamp")) + F.pmod(F.xxhash64(*["order_id"]), F.lit(900))
    far = {"sent": F.col("sent") + F.expr("INTERVAL 30 DAY")}

    def streamed(df, name):
        ends = with_end(df, **far).withColumn("arrival", late)
        return feed(spark, ends, ["arrival"], f"{root}/{name}").drop("arrival")
    both = joined.orders_with_lines(streamed(orders, "orders"), streamed(lines, "lines"), "sent", "10 minutes", "1 hour")
    runs.append_sink(both, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").where("coalesce(order_id, line_order_id) is not null") \
        .select("order_id", "order_user_id", "item_id", "line_order_id", "quantity")


@query("stream_bursts", """
WITH w AS (SELECT date_trunc('hour', ts) AS window_start, count(*) AS rows FROM events GROUP BY 1),
p AS (SELECT *, CAST(sum(rows) OVER b AS DOUBLE) / nullif(count(rows) OVER b, 0) AS usual FROM w
      WINDOW b AS (ORDER BY window_start RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING))
SELECT window_start, rows, usual, CASE WHEN rows >= usual * 1.5 THEN 1 ELSE 0 END AS burst FROM p""",
       ts="window_start", whole="burst")
def _(spark, sf):
    """Bursts leave the stream itself, hour by hour, once the watermark has closed an hour."""
    root = scratch_dir(spark, "bursts")
    rows = with_end(src.arrivals(spark, sf).select("event_id", "ts", "arrival"), ts=F.col("ts") + F.expr("INTERVAL 400 DAY"),
                    arrival=F.col("arrival") + 1)
    stream = feed(spark, rows, ["arrival", "event_id"], root)
    runs.append_sink(joined.bursts(stream, "ts", "1 hour", 24, 1.5, "30 days"), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@query("stream_dropped_rows", """
WITH a AS (SELECT event_id, ts, event_id + CASE WHEN event_id % 50 = 0 THEN (max(event_id) OVER ()) * 6 // 10 ELSE 0 END AS arrival FROM events),
n AS (SELECT *, (row_number() OVER (ORDER BY arrival, event_id) - 1) // CAST(ceil(count(*) OVER () / 4.0) AS BIGINT) AS batch FROM a),
m AS (SELECT batch, max(ts) AS latest FROM n GROUP BY 1),
w AS (SELECT batch, max(latest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 5 SECOND AS mark FROM m)
SELECT count(*) AS seen, count(*) FILTER (mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark) AS kept,
       count(*) FILTER (date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark) AS dropped FROM n JOIN w ON n.batch = w.batch""")
def _(spark, sf):
    """Rows seen, from reports of all batches, less the rows in windows: those the watermark dropped."""
    root = scratch_dir(spark, "dropped")
    rows = src.events(spark, sf).select("event_id", "ts")
    behind = F.floor(rows.agg(F.max("event_id")).scalar() * 6 / 10)
    late = rows.withColumn("arrival", F.col("event_id") + F.when(F.col("event_id") % 50 == 0, behind).otherwise(0))
    stream = feed(spark, late, ["arrival", "event_id"], root)
    table = windows.window_table(f"{root}/table")
    with counts.row_counts(spark, "seen") as listener:
        done = windows.window_stream(listener.observe(stream), "ts", "1 hour", "5 seconds", table, f"{root}/checkpoint")
        seen = listener.total(done)
    return table.current(spark).agg(F.lit(seen).cast("bigint").alias("seen"), F.sum("rows").alias("kept"),
                                    (F.lit(seen) - F.sum("rows")).alias("dropped"))
