"""Change logs: latest state, chunking, no-op removal, before/after pairs, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplake.functions.scalars import PRICE, price_floor, stock_floor
from shoplake.model import CANCELLED, COMPLETED, CREATED, PAID, SHIPPED
from shoplake.operators.filters import moment, set_when
from shoplake.operators.ordered import ordered_scan


def latest_per_key(df: DataFrame, keys: list[str], seq: list[str],
                   op: str | None = "op", keep_deletes: bool = False) -> DataFrame:
    """State after replaying a log in `seq` order, whatever order it arrived in.

    An aggregate, not a window: each task keeps one row per key before the shuffle,
    so a key with most of the log costs no more than any other. A key whose last
    event is a delete is gone unless `keep_deletes`.
    """
    rest = [c for c in df.columns if c not in keys]
    log = df
    if op in df.columns:
        log = df.where(F.col(op) != "UB")       # before-images carry no new state
    if "map<" in ",".join(kind for _, kind in df.dtypes):
        newest = F.max_by(F.struct(*rest), F.struct(*seq))
    else:       # rows compare as a whole, so the sequence columns travel once; equal ones are told by the other columns
        newest = F.max(F.struct(*seq, *[c for c in rest if c not in seq]))
    latest = log.groupBy(*keys).agg(newest.alias("_row")).select(*keys, *[F.col(f"_row.`{c}`") for c in rest])
    if op in df.columns and not keep_deletes:
        latest = latest.where(F.col(op) != "D")
    return latest.select(*df.columns)


def number_rows(log: DataFrame, order: list[str], name: str = "order_no",
                pieces: int | None = None) -> DataFrame:
    """Global 1-based position in `order`, without a single-task window."""
    return ordered_scan(log, [], order, number=name, pieces=pieces)


ORDER = ("change_time", "change_id")


def in_chunks(log: DataFrame, n: int, pieces: int | None = None, order: tuple[str, str] = ORDER) -> DataFrame:
    """`log` with `chunk_no`, from 0: n rows each in `order`. Numbered once, however often it is read."""
    numbered = number_rows(log, list(order), "_no", pieces)
    return numbered.withColumn("chunk_no", F.floor((F.col("_no") - 1) / n).cast("bigint")).drop("_no")


def last_per_chunk(chunked: DataFrame, key: str = "product_id", order: tuple[str, str] = ORDER) -> DataFrame:
    """The last change of each product in each chunk."""
    rest = [c for c in chunked.columns if c not in (key, "chunk_no")]
    return (chunked.groupBy("chunk_no", key)
            .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
            .select("chunk_no", key, "_row.*"))


def collapse_per_chunk(log: DataFrame, n: int, key: str = "product_id", order: tuple[str, str] = ORDER,
                       pieces: int | None = None) -> DataFrame:
    """Only the last change of a product within every n-row chunk of the log."""
    return last_per_chunk(in_chunks(log, n, pieces, order), key, order)


def out_of_order(log: DataFrame, key: str = "product_id", time: str = "change_time",
                 tie: str = "change_id", pieces: int | None = None) -> DataFrame:
    """Rows whose time does not lie strictly after the previous change of the key."""
    seen = ordered_scan(log, [key], [time, tie], previous={"prev_time": time}, pieces=pieces)
    return seen.where(F.col("prev_time").isNotNull() & (F.col(time) <= F.col("prev_time")))


def suppress_noop(log: DataFrame, key: str, values: list[str], order: list[str],
                  pieces: int | None = None, keep_segment: bool = False) -> DataFrame:
    """Drop rows that repeat the previous value(s) of their key; the first row stays."""
    marked = log.withColumns({f"_v_{v}": F.col(v) for v in values}).withColumn("_seen", F.lit(1))
    before = {f"_p_{v}": v for v in values}
    seen = ordered_scan(marked, [key], order, previous={**before, "_p_seen": "_seen"},
                        pieces=pieces, keep_segment=keep_segment)
    moved = F.lit(False)
    for v in values:
        moved = moved | ~F.col(f"_p_{v}").eqNullSafe(F.col(v))
    kept = seen.where(F.col("_p_seen").isNull() | moved)
    return kept.drop("_seen", "_p_seen", *[f"_v_{v}" for v in values], *before)


def derive_old_value(log: DataFrame, key: str = "product_id", new: str = "new_price",
                     old: str = "old_price", order: tuple[str, ...] = ("change_time", "change_id"),
                     pieces: int | None = None) -> DataFrame:
    """Rebuild the before-value of each change; the first version has none."""
    return ordered_scan(log, [key], list(order), previous={old: new}, pieces=pieces)


def bracket_changes(upserts: DataFrame, keys: list[str], seq: str,
                    pieces: int | None = None) -> DataFrame:
    """Latest-state rows -> change rows: I for a new key, else UB (before) and UA (after)."""
    rest = [c for c in upserts.columns if c not in keys]
    packed = upserts.select(*keys, F.col(seq).alias("_seq"), F.struct(*rest).alias("_now"))
    paired = ordered_scan(packed, keys, ["_seq"], previous={"_was": "_now"}, pieces=pieces)
    kind = packed.schema["_now"].dataType

    def event(op: str, row: Column) -> Column:
        return F.struct(F.lit(op).alias("op"), row.cast(kind).alias("row"))

    events = F.when(F.col("_was").isNull(), F.array(event("I", F.col("_now")))).otherwise(
        F.array(event("UB", F.col("_was")), event("UA", F.col("_now"))))
    return (paired.select(*keys, "_seq", F.explode(events).alias("_e"))
            .select(*keys, "_e.row.*", "_e.op", F.col("_seq").alias("change_seq")))


def with_init_rows(log: DataFrame, products: DataFrame, start: str) -> DataFrame:
    """Give every product a first version at the range start.

    Its price is the value before the first recorded change, or the current price
    for a product that never changed. Init ids are negative, so they sort first.
    """
    first = log.groupBy("product_id").agg(
        F.min_by(F.coalesce("old_price", "new_price"), F.struct("change_time", "change_id")).alias("_first"))
    init = (products.join(first, "product_id", "left")
            .select((-F.col("product_id") - 1).alias("change_id"), "product_id",
                    F.lit(None).cast(PRICE).alias("old_price"),
                    F.coalesce("_first", "price").cast(PRICE).alias("new_price"),
                    F.lit("INIT").alias("change_type"), moment(start).alias("change_time")))
    return init.unionByName(log.select(init.columns))


def hard_delete(orders: DataFrame, items: DataFrame, keys: DataFrame
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove orders and their lines; also return the delete events of both tables."""
    ids = keys.select("order_id").distinct()
    events = (orders.join(ids, "order_id", "left_semi")
              .select(F.lit("fact_order").alias("entity"), F.col("order_id").alias("id"))
              .unionByName(items.join(ids, "order_id", "left_semi")
                           .select(F.lit("fact_order_item").alias("entity"), F.col("item_id").alias("id")))
              .withColumn("op", F.lit("D")))
    return (orders.join(ids, "order_id", "left_anti").select(*orders.columns),
            items.join(ids, "order_id", "left_anti").select(*items.columns), events)


# ---- batch state steps ------------------------------------------------------
def _chosen(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    marks = keys.select(key).distinct().withColumn("_chosen", F.lit(True))
    return df.join(marks, key, "left")


def advance_orders(orders: DataFrame, keys: DataFrame, as_of: str) -> DataFrame:
    """Move the chosen orders one step along the life cycle and stamp the milestone."""
    now = moment(as_of)
    chosen = F.col("_chosen").isNotNull()
    status = F.col("order_status")
    steps = {CREATED: (PAID, "pay_time"), PAID: (SHIPPED, "shipping_time"),
             SHIPPED: (COMPLETED, "complete_time")}
    target = status
    sets: dict[str, Column] = {}
    for old, (new, stamp) in steps.items():
        target = F.when(status == old, F.lit(new)).otherwise(target)
        sets[stamp] = F.when(status == old, now).otherwise(F.col(stamp))
    moving = chosen & status.isin(*steps)
    return set_when(_chosen(orders, keys, "order_id"), moving,
                    {**sets, "update_time": now, "order_status": target}) \
        .select(*orders.columns)


def cancel_orders(orders: DataFrame, keys: DataFrame, as_of: str) -> DataFrame:
    """Cancel the chosen orders; only unpaid-for-shipping states may be cancelled."""
    now = moment(as_of)
    guard = F.col("_chosen").isNotNull() & F.col("order_status").isin(CREATED, PAID)
    return set_when(_chosen(orders, keys, "order_id"), guard,
                    {"order_status": F.lit(CANCELLED), "cancel_time": now, "update_time": now}) \
        .select(*orders.columns)


def deactivate(df: DataFrame, keys: DataFrame, key: str, as_of: str) -> DataFrame:
    """Close the chosen users, or take the chosen products off the shelf."""
    now = moment(as_of)
    guard = F.col("_chosen").isNotNull() & (F.col("status") == 1)
    return set_when(_chosen(df, keys, key), guard, {"status": F.lit(0), "update_time": now}) \
        .select(*df.columns)


def offshelf_log(products: DataFrame, keys: DataFrame, as_of: str) -> DataFrame:
    """The log rows that go with `deactivate` on products: price kept, type OFFSHELF."""
    hit = _chosen(products, keys, "product_id").where(F.col("_chosen").isNotNull() & (F.col("status") == 1))
    return hit.select("product_id", F.col("price").alias("old_price"), F.col("price").alias("new_price"),
                      F.lit("OFFSHELF").alias("change_type"), moment(as_of).alias("change_time"))


def adjust_prices(products: DataFrame, adjustments: DataFrame, as_of: str
                  ) -> tuple[DataFrame, DataFrame]:
    """Apply a table (product_id, new_price, stock_delta) to products on sale.

    Prices stop at the floor, stock at zero. Returns (products, change rows).
    """
    now = moment(as_of)
    joined = products.join(adjustments.select("product_id", F.col("new_price").alias("_price"),
                                              F.col("stock_delta").alias("_delta")),
                           "product_id", "left")
    hit = F.col("_price").isNotNull() & (F.col("status") == 1)
    floored = price_floor(F.col("_price").cast(PRICE))
    log = joined.where(hit).select(
        "product_id", F.col("price").alias("old_price"), floored.alias("new_price"),
        F.lit("ADJUST").alias("change_type"), now.alias("change_time"))
    updated = set_when(joined, hit, {
        "stock": stock_floor(F.col("stock") + F.coalesce("_delta", F.lit(0))),
        "price": floored, "update_time": now}).select(*products.columns)
    return updated, log


def event_counters(log: DataFrame, entity: str = "entity", op: str = "op") -> DataFrame:
    """How often each kind of change hit each entity."""
    return log.groupBy(entity, op).agg(F.count(F.lit(1)).alias("events"))


def chunk_stats(log: DataFrame, products: DataFrame, n: int, pieces: int | None = None) -> DataFrame:
    """Replay counts per chunk: rows read, rows that move a price, rows that change nothing.

    A chunk applies the last change of each product; it moves a row when the value
    differs from the one left by the chunk before (at first: the product's price).
    """
    numbered = in_chunks(log, n, pieces)
    last = last_per_chunk(numbered)
    seen = ordered_scan(last, ["product_id"], ["chunk_no"], previous={"_before": "new_price"},
                        pieces=pieces)
    base = products.select("product_id", F.col("price").alias("_start"))
    applied = seen.join(base, "product_id", "left")
    was = F.coalesce("_before", "_start")
    updated = F.count_if(was.isNotNull() & (was != F.col("new_price")))
    applied = applied.groupBy("chunk_no").agg(
        F.count(F.lit(1)).alias("products"), updated.alias("updated"))
    rows = numbered.groupBy("chunk_no").agg(F.count(F.lit(1)).alias("processed"))
    return (rows.join(applied, "chunk_no")
            .select("chunk_no", "processed", "products", "updated",
                    (F.col("products") - F.col("updated")).alias("unchanged")))
