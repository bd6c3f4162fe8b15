"""Row filters. Each keeps plain comparisons on stored columns so scans can prune."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplake.operators.ordered import ordered_scan


def moment(value: str | dt.datetime) -> Column:
    """A literal wall-clock time."""
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def active_only(df: DataFrame) -> DataFrame:
    return df.where((F.col("status") == 1) & (F.col("is_deleted") == 0))


def status_in(df: DataFrame, statuses: list[str], column: str = "order_status") -> DataFrame:
    return df.where(F.col(column).isin(*statuses))


def exclude_types(df: DataFrame, types: list[str], column: str = "change_type") -> DataFrame:
    return df.where(~F.col(column).isin(*types))


def stale(df: DataFrame, as_of: str, minutes: int, status: str | int | None = None,
          status_column: str = "order_status") -> DataFrame:
    """Rows not touched for `minutes` before `as_of` (an argument, never the clock)."""
    edge = dt.datetime.fromisoformat(as_of) - dt.timedelta(minutes=minutes)
    out = df.where(F.col("update_time") < moment(edge))
    return out if status is None else out.where(F.col(status_column) == status)


def time_slice(df: DataFrame, start: str, end: str, column: str = "change_time") -> DataFrame:
    """Half-open [start, end)."""
    return df.where((F.col(column) >= moment(start)) & (F.col(column) < moment(end)))


def changed_only(df: DataFrame, old: str, new: str) -> DataFrame:
    """Only rows whose value really moves (NULL counts as a value)."""
    return df.where(~F.col(old).eqNullSafe(F.col(new)))


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in a fixed order."""
    return df.select(*columns)


def incremental_read(df: DataFrame, since: str) -> DataFrame:
    """Rows changed after a high-water mark.

    A logical delete stamps deleted_time but not update_time, so both count; either test
    reaches the scan.
    """
    return df.where((F.col("update_time") > moment(since)) | (F.col("deleted_time") > moment(since)))


def set_when(df: DataFrame, condition: Column, assignments: dict[str, Column]) -> DataFrame:
    """Guarded update: set columns where the condition holds, leave others alone."""
    guard = F.coalesce(condition, F.lit(False))
    kinds = dict(df.dtypes)
    updated = {c: F.when(guard, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in assignments.items()}
    return df.withColumns(updated)


def apply_value_map(df: DataFrame, updates: DataFrame, key: str,
                    columns: list[str], guard: str | None = None) -> DataFrame:
    """Set `columns` from the matching row of `updates` (one row per key).

    With `guard`, rows whose guarded column would not move are left untouched, so
    their timestamps do not advance either.
    """
    incoming = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns],
                              F.lit(True).alias("_hit"))
    joined = df.join(incoming, key, "left")
    hit = F.col("_hit").isNotNull()
    if guard:
        hit = hit & ~F.col(guard).eqNullSafe(F.col(f"_new_{guard}"))
    picks = [F.when(hit, F.col(f"_new_{c}").cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
             if c in columns else F.col(c) for c in df.columns]
    return joined.select(*picks)


def oldest_n(df: DataFrame, n: int, time: str = "update_time", key: str = "order_id") -> DataFrame:
    """The n least recently changed rows; the key breaks ties."""
    return df.orderBy(time, key).limit(n)


def soft_delete(df: DataFrame, condition: Column, as_of: str, key: str,
                limit: int | None = None, time: str = "update_time") -> DataFrame:
    """Flag live rows meeting the condition, oldest first up to `limit`.

    update_time is left alone, as the source does; readers use `incremental_read`.
    """
    doomed = F.coalesce(condition, F.lit(False)) & (F.col("is_deleted") == 0)
    if limit is not None:
        # The n-th oldest (time, key) is one row; compare against it instead of joining keys.
        edge = (df.where(doomed).select(F.struct(time, key).alias("_at")).orderBy("_at").limit(limit)
                .agg(F.max("_at")))
        doomed = doomed & F.coalesce(F.struct(time, key) <= edge.scalar(), F.lit(False))
    return set_when(df, doomed, {"is_deleted": F.lit(1), "deleted_time": moment(as_of)})


def keyset_page(df: DataFrame, after: tuple[str, int] | None, n: int,
                time: str = "change_time", key: str = "change_id") -> DataFrame:
    """The next n rows after a (time, id) cursor; rows sharing a time are not lost."""
    page = df
    if after is not None:
        t, i = moment(after[0]), F.lit(after[1])
        page = df.where((F.col(time) >= t) & ((F.col(time) > t) | (F.col(key) > i)))
    return page.orderBy(time, key).limit(n)


def replay_order(df: DataFrame, time: str = "change_time", key: str = "change_id") -> DataFrame:
    """Total order for replay, range-partitioned."""
    return df.orderBy(time, key)


def _draw(key: str, seed: int) -> Column:
    """A repeatable shuffle order, the same on every engine."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def pool(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """A repeatable pool of n rows."""
    return df.orderBy(_draw(key, seed), key).limit(n)


def pick_n_per_group(df: DataFrame, by: list[str], n: int, key: str, seed: int = 0,
                     pieces: int | None = None) -> DataFrame:
    """n rows of each group without replacement, repeatable for a seed."""
    drawn = df.withColumn("_draw", _draw(key, seed))
    ranked = ordered_scan(drawn, by, ["_draw", key], number="_nr", pieces=pieces)
    return ranked.where(F.col("_nr") <= n).drop("_draw", "_nr")
