"""Per-key work in the state store: life-cycle steps, order snapshots, images before a change.

The state of an order is one small row, kept by the store between batches; images before a
change are kept for a bucket of keys at a time. No batch reads a table. Orders that have ended leave the state after a grace period of event time, so it is
bounded by the open orders. A key's rows of one batch meet in one task, in order of `seq`.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState

from shoplake.functions.textfields import escape_field, fields_of
from shoplake.model import CANCELLED, COMPLETED, CREATED, STATUS_STEPS
from shoplake.operators.status import MILESTONES
from shoplake.sources import batches
from shoplake.streaming.runs import each_batch

ENDED = (COMPLETED, CANCELLED)
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STEPS = {*STATUS_STEPS, (None, CREATED)}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which keyed state needs."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


class _Ending(StatefulProcessor):
    """Clears a key's state `grace` microseconds of event time after it ended."""

    def __init__(self, grace: int):
        self.grace = grace

    def end_after(self, ended: int | None, timer: int | None) -> int | None:
        """Move the timer from `timer`, where the key's state says it is, and say where it is now; none for a key that goes on.

        Each word to the store is a round trip, so none is spent on a timer that stays.
        """
        at = None if ended is None else (ended + self.grace) // 1000
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)
        return at

    def close(self) -> None:
        pass


def _timed(status: DataFrame, delay: str) -> DataFrame:
    """Status rows with their event time, and the same in microseconds for the work per key."""
    return status.select("order_id", "seq", "status", F.col("ts").cast("timestamp").alias("ts")) \
        .withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay)


BAD_STEP = {"order_id": "long", "seq": "long", "from_status": "string", "to_status": "string"}


class StepCheck(_Ending):
    """Rows whose step from the key's last status is not a listed one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, status string, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        steps, latest = [], None
        for part in rows:
            steps += [(s, 1, status) for s, status in zip(part["seq"].tolist(), part["status"].tolist(), strict=True)]
            us = int(part["us"].max())
            latest = us if latest is None else max(latest, us)
        held = self.last.get()
        timer = None
        if held is not None:
            seq, status, timer = held
            steps.append((seq, 0, status))
        steps.sort(key=lambda s: s[:2])
        bad, before = [], None
        for seq, new, status in steps:
            if new and (before, status) not in _STEPS:
                bad.append((key[0], seq, before, status))
            before = status
        timer = self.end_after(latest if before in ENDED else None, timer)
        self.last.update((int(steps[-1][0]), before, timer))
        if bad:
            yield pd.DataFrame(bad, columns=list(BAD_STEP))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()


def invalid_steps_in_state(status: DataFrame, delay: str, grace_seconds: int) -> DataFrame:
    """(order_id, seq, from_status, to_status) of steps that break the life cycle.

    `status` has order_id, seq, status and ts; rows more than `delay` behind the latest ts
    may be dropped. An order that ended is forgotten `grace_seconds` after; a row that comes
    later starts it anew.
    """
    return _timed(status, delay).groupBy("order_id").transformWithStateInPandas(
        StepCheck(grace_seconds * 1_000_000), ", ".join(f"{c} {t}" for c, t in BAD_STEP.items()), "Append", "EventTime")


TIMES = {CREATED: "order_time", **MILESTONES}


class Milestones(_Ending):
    """The first time of each status; a row for every change, the last one as closed when the state goes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", ", ".join(f"{c} long" for c in [*TIMES.values(), "timer"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        *held, timer = self.times.get() or (None,) * (len(TIMES) + 1)
        firsts = found.groupby("status")["us"].min().to_dict()
        times = tuple(min((int(t) for t in (old, firsts.get(s)) if t is not None), default=None)
                      for s, old in zip(TIMES, held, strict=True))
        done = [t for s, t in zip(TIMES, times, strict=True) if s in ENDED and t is not None]
        ends = self.end_after(max(int(found["us"].max()), *done) if done else None, timer)
        if times != tuple(held) or ends != timer:
            self.times.update((*times, ends))
        if times != tuple(held):
            yield self.row(key[0], times, False)

    def row(self, order_id: int, times: tuple, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({"order_id": [order_id], "closed": [closed],
                             **{c: pd.array([t], dtype="Int64") for c, t in zip(TIMES.values(), times, strict=True)}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        times = tuple(self.times.get())[:-1]
        self.times.clear()
        yield self.row(key[0], times, True)


def milestones_in_state(status: DataFrame, delay: str, grace_seconds: int) -> DataFrame:
    """Order snapshots (order_id, closed, a time per milestone) as they change, in append mode.

    The last row of an order that ended is `closed` and comes `grace_seconds` after; rows that
    come later still start a new snapshot, which `life_snapshot` merges with it.
    """
    shape = "order_id long, closed boolean, " + ", ".join(f"{c} long" for c in TIMES.values())
    rows = _timed(status, delay).groupBy("order_id").transformWithStateInPandas(
        Milestones(grace_seconds * 1_000_000), shape, "Append", "EventTime")
    return rows.select("order_id", "closed", *[F.timestamp_micros(c).alias(c) for c in TIMES.values()])


def life_snapshot(kept: DataFrame) -> DataFrame:
    """One row per order from the rows that `milestones_in_state` gave: the earliest time of each milestone.

    Rows come when a milestone is new, so there are a handful per order, and none is read while the stream runs.
    """
    return kept.groupBy("order_id").agg(*[F.min(c).cast("timestamp_ntz").alias(c) for c in TIMES.values()])


HELD = "blob binary"            # rows (key, seq, gone, line) of the keys of one bucket, as an Arrow stream


def _unpacked(blob: bytes | None) -> pd.DataFrame:
    if blob is None:
        return pd.DataFrame({"key": pd.Series(dtype=object), "seq": pd.Series(dtype="int64"),
                             "gone": pd.Series(dtype=bool), "line": pd.Series(dtype=object)})
    return pa.ipc.open_stream(pa.BufferReader(blob)).read_all().to_pandas()


def _packed(held: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(held, schema=pa.schema([
        ("key", pa.string()), ("seq", pa.int64()), ("gone", pa.bool_()), ("line", pa.string())]), preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _images(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """For each change the key's line before it (sign -1) and after it (sign 1). Old and repeated changes do nothing."""
    # only the newest change of a batch counts: what lies between is added and taken away again
    newest = None
    for part in parts:
        both = part if newest is None else pd.concat([newest, part])
        newest = both.sort_values("seq", ascending=False, kind="stable").drop_duplicates("key")
    held = _unpacked(state.get[0] if state.exists else None)
    before = held.set_index("key").reindex(newest["key"])
    fresh = ~(before["seq"].to_numpy() >= newest["seq"].to_numpy())      # a key that is not held has no number, so nothing holds it back
    newest, before = newest[fresh], before[fresh]
    if newest.empty:
        return
    taken = before.loc[before["gone"].eq(False), "line"]
    gone = newest["op"].eq("D")
    added = newest.loc[~gone, "line"]
    after = pd.DataFrame({"key": newest["key"], "seq": newest["seq"], "gone": gone, "line": newest["line"].where(~gone, None)})
    rest = held[~held["key"].isin(newest["key"])]
    state.update((_packed(pd.concat([rest, after]) if len(rest) else after),))
    yield pd.DataFrame({"line": [*taken, *added], "sign": [-1] * len(taken) + [1] * len(added)})


def signed_images(changes: DataFrame, key: str, columns: dict[str, str], buckets: int = 256) -> DataFrame:
    """Minus and plus rows from changes without images of what they replace.

    `changes` has `key`, the columns of {column: type}, op and seq. A deleted key keeps its
    sequence number, so that a late change cannot bring it back.

    The state store holds the last rows of all keys of a bucket in one value, and a call works on a
    bucket's keys at once; a call per key costs milliseconds. A batch rewrites the buckets it touches, so
    choose `buckets` for some thousand keys each (`bucket_count`). A stream keeps its number for good.
    """
    line = F.concat_ws("\t", *[escape_field(F.col(c).cast(t)) for c, t in columns.items()])
    rows = changes.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), escape_field(F.col(key)).alias("key"),
                          "op", F.col("seq").cast("bigint").alias("seq"), line.alias("line"))
    signed = rows.groupBy("bucket").applyInPandasWithState(_images, "line string, sign int", HELD, "Update", "NoTimeout")
    return signed.select(*fields_of("line", columns), "sign")


def signs_of(changes: DataFrame) -> DataFrame:
    """Minus and plus rows from a log that has both images: UB and D take away, I and UA add."""
    sign = F.when(F.col("op").isin("I", "UA"), 1).when(F.col("op").isin("UB", "D"), -1)
    return changes.withColumn("sign", sign).where("sign is not null")


def signed_sums(signed: DataFrame, by: list[str], sums: dict[str, str]) -> DataFrame:
    """Changes of the sums {new column: long column or expression} and of `rows`, per group."""
    return signed.groupBy(*by).agg(F.sum("sign").cast("bigint").alias("rows"),
                                   *[F.sum(F.expr(e).cast("bigint") * F.col("sign")).alias(c) for c, e in sums.items()])


def kept_sums(stored: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """The groups that have rows left, from all stored changes of sums."""
    return stored.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("rows", *sums)]).where(F.col("rows") > 0)


def keep_sums(signed: DataFrame, by: list[str], sums: dict[str, str], path: str, checkpoint: str,
              every: str | None = None) -> StreamingQuery:
    """Store, per batch, how the sums of each touched group change; no batch reads what is stored."""
    def add(batch: DataFrame, batch_id: int, run: str) -> None:
        batches.write_batch(signed_sums(batch, by, sums), path, run, batch_id)

    return each_batch(signed, add, checkpoint, every, hold=False)
