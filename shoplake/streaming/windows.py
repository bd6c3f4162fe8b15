"""Event-time operators: windows, late rows, de-duplication, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shoplake.functions.scalars import ratio
from shoplake.operators.ordered import ordered_scan
from shoplake.sources.keyed import KeyedTable
from shoplake.streaming.runs import each_batch


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Wall-clock column as an instant; watermarks need one."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def tumbling_counts(df: DataFrame, ts: str, width: str, delay: str | None = None,
                    by: list[str] | None = None) -> DataFrame:
    """Rows per event-time window. With `delay`, rows later than it are dropped."""
    timed = event_time(df, ts)
    if delay is not None:
        timed = timed.withWatermark(ts, delay)
    counts = timed.groupBy(F.window(ts, width).alias("_w"), *(by or [])).agg(F.count(F.lit(1)).alias("rows"))
    return counts.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
                         *(by or []), "rows")


def window_stream(stream: DataFrame, ts: str, width: str, delay: str, table: KeyedTable, checkpoint: str,
                  every: str | None = None) -> StreamingQuery:
    """Keep event-time window counts in a keyed table; each change of a window replaces it.

    State is kept for the delay only. Counts grow, so the largest is the latest.
    """
    counts = tumbling_counts(stream, ts, width, delay)
    return each_batch(counts, table.append, checkpoint, every)


def window_table(path: str) -> KeyedTable:
    schema = T.StructType([T.StructField("window_start", T.TimestampType()),
                           T.StructField("window_end", T.TimestampType()), T.StructField("rows", T.LongType())])
    return KeyedTable(path, schema, ["window_start"], ["rows"])


def split_late(df: DataFrame, arrival: str, ts: str, delay_seconds: float,
               pieces: int | None = None) -> DataFrame:
    """Mark rows that arrive more than the delay behind the latest time seen before."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    seen = ordered_scan(df.withColumn("_us", micros), [], [arrival], peak_before={"_max": "_us"},
                        pieces=pieces)
    edge = F.col("_max") - F.lit(int(delay_seconds * 1_000_000))
    return (seen.withColumn("late", F.when(F.col("_us") < edge, 1).otherwise(0)).drop("_us", "_max"))


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows a finished query dropped for being late.

    Spark keeps the latest progress reports only. If some may be gone already, this is
    an error and not a smaller number; `counts.RowCounts` counts over any run length.
    """
    spark = SparkSession.getActiveSession()
    kept = int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100")) if spark else 100
    if len(query.recentProgress) >= kept - 1:
        raise ValueError(f"only the last {kept} progress reports are kept; earlier drops are not counted")
    total = 0
    for progress in query.recentProgress:
        for state in progress["stateOperators"]:
            total += int(state["numRowsDroppedByWatermark"])
    return total


def drop_repeats(stream: DataFrame, key: str, ts: str, within: str) -> DataFrame:
    """Each key once; state is kept only for the watermark span."""
    return event_time(stream, ts).withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def window_rates(df: DataFrame, ts: str, width_seconds: int, target_rate: float, trailing: int,
                 burst_factor: float) -> DataFrame:
    """Rate per window against a target, and whether it bursts over the trailing average."""
    return rates(tumbling_counts(df, ts, f"{width_seconds} seconds"), width_seconds, target_rate, trailing,
                 burst_factor)


def rates(counts: DataFrame, width_seconds: int, target_rate: float, trailing: int, burst_factor: float) -> DataFrame:
    """Rates and bursts from window counts, of a batch or as a stream has kept them.

    The sum of the trailing windows is the difference of two running sums, so no window
    of rows is gathered however narrow the time windows are.
    """
    summed = ordered_scan(counts.select("window_start", "rows"), [], ["window_start"], number="_nr",
                          running={"_sum": "rows"})
    old = summed.select((F.col("_nr") + trailing + 1).alias("_nr"), F.col("_sum").alias("_old"))
    placed = summed.join(old, "_nr", "left")
    before = F.col("_sum") - F.col("rows") - F.coalesce("_old", F.lit(0))
    usual = before / F.nullif(F.least(F.col("_nr") - 1, F.lit(trailing)), F.lit(0))
    return placed.select(
        "window_start", "rows", ratio("rows", F.lit(width_seconds)).alias("rate"),
        F.round(F.col("rows") / F.lit(float(width_seconds)) / F.lit(float(target_rate)), 6).alias("of_target"),
        F.when(F.col("rows") >= usual * F.lit(float(burst_factor)), 1).otherwise(0).alias("burst"))
