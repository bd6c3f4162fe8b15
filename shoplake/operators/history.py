"""Price and attribute history: SCD2 building and point-in-time lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplake.operators.ordered import ordered_scan
from shoplake.operators.changes import suppress_noop


def build_scd2_multi(log: DataFrame, key: str, tracked: Sequence[str], ts: str, seq: str, *,
                     start: str = "start_time", end: str = "end_time",
                     pieces: int | None = None) -> DataFrame:
    """Versions of `tracked` per key as half-open [start, end) intervals.

    Rows of one instant collapse to the last by `seq` (no zero-length versions); a
    row that repeats the current values opens no version. The end is NULL while
    current. Late or repeated log rows give the same result as ordered ones.
    """
    values = list(tracked)
    instants = (log.groupBy(key, ts)
                .agg(F.max_by(F.struct(*values), F.col(seq)).alias("_v"))
                .select(key, ts, "_v.*"))
    changed = suppress_noop(instants, key, values, [ts], pieces=pieces, keep_segment=True)
    spans = ordered_scan(changed, [key], [ts], following={end: ts}, number="version_no",
                         presplit=True)
    return spans.select(key, *values, F.col(ts).alias(start), end,
                        F.when(F.col(end).isNull(), 1).otherwise(0).alias("is_current"), "version_no")


def build_scd2(log: DataFrame, key: str = "product_id", value: str = "new_price",
               ts: str = "change_time", seq: str = "change_id",
               pieces: int | None = None) -> DataFrame:
    """Price versions: price, price_start_time, price_end_time, is_current, version_no."""
    versions = build_scd2_multi(log, key, [value], ts, seq, start="price_start_time",
                                end="price_end_time", pieces=pieces)
    return versions.withColumnRenamed(value, "price")


def asof_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str,
              values: Mapping[str, str], *, right_seq: str | None = None,
              granularity: str = "exact", pieces: int | None = None) -> DataFrame:
    """Add to each left row the `values` of the last right row at or before its time.

    `values` is {new column: right column}; NULL where nothing precedes. With
    granularity='second' both times are first rounded to the nearest second. The
    two sides are merged in time order and the last right row is carried forward,
    so work is linear in the rows of a key however many versions it has.
    """
    def at(df: DataFrame, ts: str):
        stamp = df[ts].cast("timestamp_ntz")
        if granularity == "second":
            return F.date_trunc("second", df[ts].cast("timestamp") + F.expr("INTERVAL 0.5 SECOND")) \
                .cast("timestamp_ntz")
        return stamp

    tie = F.col(right_seq).cast("bigint") if right_seq else F.lit(0).cast("bigint")
    held = F.struct(*[F.col(src).alias(out) for out, src in values.items()])
    versions = right.select(F.col(by).alias(by), at(right, right_ts).alias("_at"), F.lit(0).alias("_side"),
                            tie.alias("_tie"), held.alias("_held"))
    facts = left.select(F.col(by).alias(by), at(left, left_ts).alias("_at"), F.lit(1).alias("_side"),
                        F.lit(0).cast("bigint").alias("_tie"), F.struct(*left.columns).alias("_row"))
    merged = facts.unionByName(versions, allowMissingColumns=True)
    scanned = ordered_scan(merged, [by], ["_at", "_side", "_tie"], filled={"_last": "_held"},
                           pieces=pieces)
    return (scanned.where(F.col("_side") == 1)
            .select("_row.*", *[F.col("_last")[out].alias(out) for out in values]))


def price_at(items: DataFrame, log: DataFrame, products: DataFrame, *, time: str = "create_time",
             granularity: str = "exact", pieces: int | None = None) -> DataFrame:
    """Price in force for each line; a product without an earlier change uses its base price."""
    hit = asof_join(items, log, "product_id", time, "change_time", {"_price": "new_price"},
                    right_seq="change_id", granularity=granularity, pieces=pieces)
    base = products.select("product_id", F.col("price").alias("_base"))
    return (hit.join(base, "product_id", "left")
            .withColumn("asof_price", F.coalesce("_price", "_base")).drop("_price", "_base"))


def scd2_join(facts: DataFrame, scd2: DataFrame, time: str = "create_time", key: str = "product_id",
              pieces: int | None = None) -> DataFrame:
    """Version in force for each fact row (t in [start, end)); NULLs where there is none.

    Versions of a key do not overlap, so the last one started is the only candidate.
    """
    found = asof_join(facts, scd2, key, time, "price_start_time",
                      {"version_price": "price", "version_no": "version_no", "_end": "price_end_time"},
                      pieces=pieces)
    inside = F.col("version_no").isNotNull() & (F.col("_end").isNull() | (F.col(time) < F.col("_end")))
    return found.withColumns({c: F.when(inside, F.col(c)) for c in ("version_price", "version_no")}) \
        .drop("_end")
