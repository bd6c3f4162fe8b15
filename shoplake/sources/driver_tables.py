"""The order model read from the TPC-H-like test tables.

Where a model column has no counterpart, a fixed rule on the row's own columns
fills it, so the work grows with the tables and the rules are repeatable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplake.functions.scalars import AMOUNT, PRICE, from_cents
from shoplake.model import CANCELLED, COMPLETED, CREATED, PAID, SHIPPED

EVENT_STATUS = {"view": CREATED, "click": PAID, "purchase": SHIPPED,
                "signup": COMPLETED, "error": CANCELLED}


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _none(kind: str):
    return F.lit(None).cast(kind)


def _hours(base, amount):
    return base + F.make_dt_interval(F.lit(0), amount)


def users(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (_read(spark, sf, t) for t in ("customer", "nation", "region"))
    place = n.join(r, n.n_regionkey == r.r_regionkey)
    key = F.col("c_custkey")
    phone = F.concat(F.lit("1"), (key % 10).cast("string"), F.lpad(key.cast("string"), 9, "0"))
    since = F.lit("1994-01-01").cast("timestamp_ntz") + F.make_dt_interval((key % 365).cast("int"))
    return c.join(place, c.c_nationkey == n.n_nationkey).select(
        key.alias("user_id"), F.col("c_name").alias("username"), phone.alias("phone"),
        _none("string").alias("email"), F.col("r_name").alias("province"), F.col("n_name").alias("city"),
        (key % 3 + 1).cast("tinyint").alias("user_level"),
        F.when(F.col("c_acctbal") < 0, 0).otherwise(1).cast("tinyint").alias("status"),
        F.col("c_mktsegment").alias("register_channel"), _none("timestamp_ntz").alias("first_order_time"),
        F.lit(0).cast("tinyint").alias("is_deleted"), _none("timestamp_ntz").alias("deleted_time"),
        since.alias("create_time"), since.alias("update_time"))


def products(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    price = F.col("p_retailprice").cast(PRICE)
    since = F.lit("1994-01-01").cast("timestamp_ntz") + F.make_dt_interval((key % 365).cast("int"))
    return _read(spark, sf, "part").select(
        key.alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"), price.alias("price"),
        F.round(price * F.lit("0.70").cast("decimal(3,2)"), 2).cast(PRICE).alias("cost_price"),
        F.col("p_size").cast("int").alias("stock"),
        F.when(F.col("p_size") % 10 == 0, 0).otherwise(1).cast("tinyint").alias("status"),
        F.lit(0).cast("tinyint").alias("is_deleted"), _none("timestamp_ntz").alias("deleted_time"),
        since.alias("create_time"), since.alias("update_time"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """F is COMPLETED; P is PAID or, when urgent, SHIPPED; O is CREATED or, when low, CANCELLED."""
    key = F.col("o_orderkey")
    code, urgency = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    status = (F.when(code == "F", COMPLETED)
              .when(code == "P", F.when(urgency.isin("1", "2"), SHIPPED).otherwise(PAID))
              .otherwise(F.when(urgency == "5", CANCELLED).otherwise(CREATED)))
    paid = _hours(F.col("o_orderdate"), (key % 48 + 1).cast("int"))
    shipped = _hours(paid, (key % 96 + 2).cast("int"))
    completed = _hours(shipped, (key % 120 + 12).cast("int"))
    cancelled = _hours(F.col("o_orderdate"), (key % 24 + 1).cast("int"))
    cents = F.rint(F.col("o_totalprice") * 100).cast("bigint")
    staged = _read(spark, sf, "orders").select(
        key.alias("order_id"), F.col("o_custkey").alias("user_id"), status.alias("order_status"),
        (key % 7 + 1).cast("int").alias("item_count"), from_cents(cents).alias("total_amount"),
        from_cents(F.when(urgency == "1", F.floor((cents * 5 + 50) / 100)).otherwise(0)).alias("discount_amount"),
        paid.alias("_paid"), shipped.alias("_shipped"), completed.alias("_completed"),
        cancelled.alias("_cancelled"), F.col("o_orderdate").alias("order_time"))
    s = F.col("order_status")
    pay = F.when(s.isin(PAID, SHIPPED, COMPLETED), F.col("_paid"))
    ship = F.when(s.isin(SHIPPED, COMPLETED), F.col("_shipped"))
    done = F.when(s == COMPLETED, F.col("_completed"))
    stop = F.when(s == CANCELLED, F.col("_cancelled"))
    gone = (s == CANCELLED) & (F.col("order_id") % 3 == 0)
    return staged.select(
        "order_id", "user_id", "order_status", "item_count", "total_amount", "discount_amount",
        pay.alias("pay_time"), ship.alias("shipping_time"), done.alias("complete_time"),
        stop.alias("cancel_time"), "order_time",
        F.greatest(F.col("order_time"), pay, ship, done, stop).alias("update_time"),
        F.when(gone, 1).otherwise(0).cast("tinyint").alias("is_deleted"),
        F.when(gone, _hours(F.col("_cancelled"), F.lit(24))).alias("deleted_time"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Lines; the unit price is the line amount per piece, half up to the cent."""
    qty = F.col("l_quantity").cast("int")
    cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    percent = F.rint(F.col("l_discount") * 100).cast("bigint")
    unit = F.floor((cents * 2 + qty) / (qty * 2)).cast("bigint")
    off = F.floor((cents * percent + 50) / 100).cast("bigint")
    return _read(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"),
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        qty.alias("quantity"), from_cents(unit, PRICE).alias("unit_price"),
        from_cents(cents).alias("subtotal"), from_cents(off).alias("discount_amount"),
        F.col("l_shipdate").alias("create_time"))


def sold_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Two lines about each price change, at the new price: 400 ms after it and, wrongly, 400 ms before."""
    side = F.explode(F.array(F.lit(1), F.lit(-1))).alias("_side")
    changes = price_log(spark, sf).where("change_type <> 'FINAL'").select("*", side)
    return changes.select(
        (-2 * F.col("change_id") - F.when(F.col("_side") > 0, 1).otherwise(2)).alias("item_id"),
        F.col("change_id").alias("order_id"), "product_id", F.lit(1).alias("quantity"), F.col("new_price").alias("unit_price"),
        F.col("new_price").cast(AMOUNT).alias("subtotal"), F.lit(0).cast(AMOUNT).alias("discount_amount"),
        F.timestamp_micros(F.unix_micros(F.col("change_time").cast("timestamp")) + 400_000 * F.col("_side"))
        .cast("timestamp_ntz").alias("create_time"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events")


def price_log(spark: SparkSession, sf: str) -> DataFrame:
    """Change log of 150 x sf/0.01 products; signup rows play the FINAL pseudo rows."""
    kind = F.col("event_type")
    return events(spark, sf).where(kind.isin("purchase", "signup", "error")).select(
        F.col("event_id").alias("change_id"), F.col("user_id").alias("product_id"),
        _none(PRICE).alias("old_price"), F.col("value").cast(PRICE).alias("new_price"),
        F.when(kind == "purchase", "ADJUST").when(kind == "error", "OFFSHELF")
        .otherwise("FINAL").alias("change_type"), F.col("ts").alias("change_time"))


def stock_log(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    pieces = F.floor("value").cast("int")
    return events(spark, sf).where(kind.isin("purchase", "click")).select(
        F.col("event_id").alias("change_id"), F.col("user_id").alias("product_id"),
        _none("bigint").alias("order_id"),
        F.when(kind == "click", "ORDER_DEDUCT").otherwise("REPLENISH").alias("change_type"),
        F.when(kind == "click", -pieces).otherwise(pieces).alias("delta"),
        (F.col("event_id") * 37 % 500).cast("int").alias("stock_after"), F.col("ts").alias("change_time"))


def status_log(spark: SparkSession, sf: str) -> DataFrame:
    status = F.lit(None).cast("string")
    for kind, name in EVENT_STATUS.items():
        status = F.when(F.col("event_type") == kind, name).otherwise(status)
    return events(spark, sf).select(F.col("user_id").alias("order_id"), F.col("event_id").alias("seq"),
                                    status.alias("status"), "ts")


def probes(spark: SparkSession, sf: str) -> DataFrame:
    """Latency rows: the sink is (id x 37 mod 1000) ms behind the writer."""
    ts = F.col("ts").cast("timestamp")
    ms = F.unix_millis(ts)
    return events(spark, sf).select(
        F.col("event_id").alias("id"), ms.alias("create_time_ms"), F.col("ts").alias("create_time"),
        F.date_trunc("second", ts).cast("timestamp_ntz").alias("source_time"),
        F.timestamp_millis(ms + F.col("event_id") * 37 % 1000).cast("timestamp_ntz").alias("sink_time"))


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Events with an arrival order; every 50th arrives 300 places late."""
    late = F.when(F.col("event_id") % 50 == 0, 300).otherwise(0)
    return events(spark, sf).select("event_id", "user_id", "event_type", "ts",
                                    (F.col("event_id") + late).alias("arrival"))


def user_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed change events: op D on error rows, latest state otherwise; seq is the event id."""
    return events(spark, sf).select(
        "user_id", F.col("event_type").alias("last_event"), F.col("value").cast(AMOUNT).alias("amount"),
        F.col("ts").alias("update_time"),
        F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "I")
        .otherwise("UA").alias("op"), F.col("event_id").alias("seq"))
