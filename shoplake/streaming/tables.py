"""Streams that keep tables: keyed upserts, price history, order snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shoplake.model import PRIMARY_KEYS, SCHEMAS, with_envelope
from shoplake.operators.history import build_scd2
from shoplake.operators.joins import lookup_join
from shoplake.operators.status import MILESTONES, is_valid_step, milestones, with_durations
from shoplake.operators.ordered import ordered_scan
from shoplake.plans.dwd import with_date_parts
from shoplake.sources import batches
from shoplake.sources.keyed import KeyedTable
from shoplake.streaming.runs import each_batch


def upsert_stream(events: DataFrame, table: KeyedTable, checkpoint: str,
                  every: str | None = None) -> StreamingQuery:
    """Keep a keyed table from change events (op, seq); late and repeated ones are safe."""
    return each_batch(events, table.append, checkpoint, every)


# ---- price history ----------------------------------------------------------
BUCKETS = 64                    # folders of the history; a batch reads those of its products


def scd2_stream(changes: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep price versions from a stream of price changes.

    A batch adds its rows to the history and rebuilds the versions of the products it
    touches, since a late change may split an old version. The history lies in folders by a
    hash of the product, and a batch reads the folders of its products only. Both writes carry
    run and batch and replace themselves on a re-run; a batch does not see later ones.
    """
    schema = T.StructType([*changes.schema.fields, T.StructField("bucket", T.LongType())])

    def rebuild(batch: DataFrame, batch_id: int, run: str) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("bucket", product_bucket())
        key = batches.write_batch(placed, f"{path}/history", run, batch_id, ("bucket",))
        touched = placed.select("product_id", "bucket").distinct()
        versions = build_scd2(touched_history(spark, f"{path}/history", schema, touched, key))
        batches.write_batch(versions, f"{path}/versions", run, batch_id)

    return each_batch(changes, rebuild, checkpoint, every)


def product_bucket() -> Column:
    return F.pmod(F.xxhash64(F.col("product_id")), F.lit(BUCKETS))


def touched_history(spark: SparkSession, path: str, schema: T.StructType, touched: DataFrame,
                    upto: batches.BatchKey) -> DataFrame:
    """Changes up to a batch of the products in `touched` (product_id, bucket), each once.

    The join on the folder column prunes the scan at run time.
    """
    stored = batches.read_batches(spark, path, schema, upto)
    buckets = touched.where("bucket >= 0").select("bucket").distinct()     # BUCKETS rows at most
    return (stored.join(F.broadcast(buckets), "bucket").join(touched, ["product_id", "bucket"], "left_semi")
            .drop("bucket", "run", "batch_id").dropDuplicates(["change_id"]))


def scd2_versions(spark: SparkSession, path: str) -> DataFrame:
    """Versions as of the last batch that touched each product."""
    stored = spark.read.parquet(f"{path}/versions")
    newest = stored.groupBy("product_id").agg(F.max(F.struct("run", "batch_id")).alias("newest"))
    at = F.struct("run", "batch_id")
    return stored.join(newest, "product_id").where(at == F.col("newest")).drop("run", "batch_id", "newest")


# ---- accumulating snapshot --------------------------------------------------
def acc_stream(status: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep order milestones from a stream of status rows (order_id, status, ts)."""
    def add(batch: DataFrame, batch_id: int, run: str) -> None:
        batches.write_batch(milestones(batch), path, run, batch_id)

    return each_batch(status, add, checkpoint, every)


def acc_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """One row per order: the earliest time of each milestone over all batches."""
    columns = ["order_time", *MILESTONES.values()]
    merged = spark.read.parquet(path).groupBy("order_id").agg(*[F.min(c).alias(c) for c in columns])
    return with_durations(merged)


def acc_stateful(status: DataFrame, watermark: str) -> DataFrame:
    """State-store form for bounded order lives: emits a row on every change (update mode)."""
    timed = status.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    firsts = [F.min(F.when(F.col("status") == s, F.col("ts"))).alias(c)
              for s, c in {"CREATED": "order_time", **MILESTONES}.items()]
    return timed.groupBy("order_id").agg(*firsts)


# ---- dimensions -------------------------------------------------------------
def date_dim_stream(facts: DataFrame, ts: str, path: str, checkpoint: str,
                    every: str | None = None) -> StreamingQuery:
    """Keep the calendar of the days seen in a stream of facts."""
    table = date_dim_table(path)

    def add(batch: DataFrame, batch_id: int, run: str) -> None:
        days = with_date_parts(batch.select(F.to_date(ts).alias("date_key")).distinct())
        table.append(days.select(*[F.col(f.name).cast(f.dataType) for f in table.schema.fields]), batch_id, run)

    return each_batch(facts, add, checkpoint, every)


def date_dim_table(path: str) -> KeyedTable:
    whole = ["year", "quarter", "month", "iso_week", "day_of_week", "is_weekend"]
    schema = T.StructType([T.StructField("date_key", T.DateType()),
                           *[T.StructField(c, T.IntegerType()) for c in whole]])
    return KeyedTable(path, schema, ["date_key"], ["date_key"])


def dim_stream(events: DataFrame, name: str, path: str, checkpoint: str,
               every: str | None = None) -> StreamingQuery:
    """Keep `dim_user` or `dim_product` from its change events."""
    return upsert_stream(events, dim_table(name, path), checkpoint, every)


def dim_table(name: str, path: str) -> KeyedTable:
    return KeyedTable(path, with_envelope(SCHEMAS[name]), PRIMARY_KEYS[name], ["seq"])


# ---- lookups and checks on streams ------------------------------------------
def lookup_stream(lines: DataFrame, products: DataFrame, columns: list[str]) -> DataFrame:
    """Stream of lines with product columns; the product side is re-read each batch."""
    return lookup_join(lines, products, columns)


def invalid_transition_stream(status: DataFrame, path: str, checkpoint: str,
                              every: str | None = None) -> StreamingQuery:
    """Write status steps that break the life cycle, across batch borders.

    The last status of each order is carried in a keyed table. A batch reads it as it
    was before that batch, so a re-run gives the same rows. Input order is `seq`. Run
    `last_status_table(path).compact` now and then to keep that read short.
    """
    last = last_status_table(path)

    def check(batch: DataFrame, batch_id: int, run: str) -> None:
        spark = batch.sparkSession
        here = batches.label(spark, last.changes, run), batch_id
        rows = batch.select("order_id", "seq", "status", F.lit(0).alias("_carried"))
        before = last.current(spark, before=here) \
            .join(rows.select("order_id").distinct(), "order_id", "left_semi") \
            .select("order_id", "seq", "status", F.lit(1).alias("_carried"))
        seen = ordered_scan(rows.unionByName(before), ["order_id"], ["seq", "_carried"],
                            previous={"from_status": "status"})
        bad = seen.where((F.col("_carried") == 0)
                         & ~F.coalesce(is_valid_step(F.col("from_status"), F.col("status")), F.lit(False)))
        bad = bad.select("order_id", "seq", "from_status", F.col("status").alias("to_status"))
        batches.write_batch(bad, f"{path}/invalid", run, batch_id)
        last.append(batch.select("order_id", "seq", "status"), batch_id, run)

    return each_batch(status, check, checkpoint, every)


def last_status_table(path: str) -> KeyedTable:
    schema = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("seq", T.LongType()),
                           T.StructField("status", T.StringType())])
    return KeyedTable(f"{path}/last_status", schema, ["order_id"], ["seq"])


def invalid_transitions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/invalid").drop("run", "batch_id")


# ---- snapshot then stream ---------------------------------------------------
def backfill_then_follow(spark: SparkSession, snapshot: DataFrame, events: DataFrame, table: KeyedTable,
                         checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Load a full snapshot as a run of its own, then apply a stream on top of it.

    Stream events older than the snapshot lose to it by `seq`, so the stream may start
    anywhere before the snapshot's position.
    """
    if not table.batches(spark):
        table.append(snapshot, 0, "snapshot")
    return upsert_stream(events, table, checkpoint, every)


def stamp_sink_time(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append rows with the time they reached the sink, for latency measurement."""
    def add(batch: DataFrame, batch_id: int, run: str) -> None:
        stamped = batch.withColumn("sink_time", F.current_timestamp().cast("timestamp_ntz"))
        batches.write_batch(stamped, path, run, batch_id)

    return each_batch(stream, add, checkpoint, every)

