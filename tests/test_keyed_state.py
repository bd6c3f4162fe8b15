"""Keyed state, change images, joined streams and chained windows against their batch forms."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import rows, typed
from shoplake.operators.status import milestones, transitions
from shoplake.streaming import counts, joined, keyed_state, runs, windows


def feed(spark, df, order, path, chunk):
    runs.stage_in_order(df, path, order, chunk)
    return runs.replay_stream(spark, path, df.schema)


STATUS = [(1, 1, "CREATED", "2024-01-01 00:00:00"), (2, 2, "CREATED", "2024-01-01 01:00:00"), (1, 3, "PAID", "2024-01-01 02:00:00"),
          (2, 4, "SHIPPED", "2024-01-01 03:00:00"), (1, 5, "SHIPPED", "2024-01-02 00:00:00"), (1, 6, "COMPLETED", "2024-01-03 00:00:00"),
          (3, 7, "PAID", "2024-01-03 01:00:00"), (1, 8, "PAID", "2024-01-03 02:00:00"), (4, 9, "CREATED", "2024-02-20 00:00:00"),
          (5, 10, "CREATED", "2024-02-20 01:00:00"), (1, 11, "SHIPPED", "2024-02-20 02:00:00"), (6, 12, "CREATED", "2024-02-20 03:00:00")]


@pytest.fixture(scope="module")
def status(spark):
    return typed(spark.createDataFrame(STATUS, "order_id long, seq long, status string, ts string"), "ts")


@pytest.mark.parametrize("chunk", [2, 5])
def test_steps_in_state_equal_the_batch_form(spark, tmp_path, status, chunk):
    stream = feed(spark, status, ["seq"], str(tmp_path / "in"), chunk)
    with keyed_state.rocksdb(spark):
        runs.append_sink(keyed_state.invalid_steps_in_state(stream, "60 days", 60 * 86_400), str(tmp_path / "o"), str(tmp_path / "c"))
    want = transitions(status).where("valid = 0").select("order_id", "seq", "from_status", "to_status")
    assert rows(spark.read.parquet(str(tmp_path / "o"))) == rows(want)


def test_ended_orders_leave_the_state(spark, tmp_path, status):
    """Order 1 ends on 3 January and is forgotten once the watermark is a day further, unless a row wakes it before."""
    closed = status.where("seq <> 8")
    stream = feed(spark, closed, ["seq"], str(tmp_path / "in"), 2)
    with keyed_state.rocksdb(spark):
        query = runs.append_sink(keyed_state.invalid_steps_in_state(stream, "1 hour", 86_400), str(tmp_path / "o"), str(tmp_path / "c"))
    got = {r["seq"]: r["from_status"] for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {4: "CREATED", 7: None, 11: "COMPLETED"}
    state = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "c"))
    assert {r["key"]["order_id"] for r in state.collect()} == {1, 2, 3, 4, 5, 6} and query.exception() is None
    stream = feed(spark, closed.where("seq <> 11"), ["seq"], str(tmp_path / "in2"), 2)
    with keyed_state.rocksdb(spark):
        runs.append_sink(keyed_state.invalid_steps_in_state(stream, "1 hour", 86_400), str(tmp_path / "o2"), str(tmp_path / "c2"))
    state = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "c2"))
    assert {r["key"]["order_id"] for r in state.collect()} == {2, 3, 4, 5, 6}


@pytest.mark.parametrize("grace", [3600, 365 * 86_400])
def test_milestones_in_state_equal_the_batch_form(spark, tmp_path, status, grace):
    status = status.where("seq <> 11")
    stream = feed(spark, status, ["seq"], str(tmp_path / "in"), 3)
    with keyed_state.rocksdb(spark):
        runs.append_sink(keyed_state.milestones_in_state(stream, "1 hour", grace), str(tmp_path / "o"), str(tmp_path / "c"))
    kept = spark.read.parquet(str(tmp_path / "o"))
    assert rows(keyed_state.life_snapshot(kept)) == rows(milestones(status))
    assert (kept.where("closed").count() > 0) == (grace == 3600)


@pytest.mark.parametrize("chunk", [1, 3, 20])
def test_sums_follow_changes_in_any_split(spark, tmp_path, chunk):
    data = [(1, "a", 10, "I", 1, 3), (1, "a", 12, "UA", 2, 1), (2, "a", 5, "I", 3, 2), (2, "b", 5, "UA", 4, 5), (3, "b", 7, "I", 5, 4),
            (3, "b", 7, "D", 6, 0), (1, "a", 12, "UA", 2, 6), (4, "c", 1, "I", 7, 7), (4, "c", 1, "D", 8, 8), (2, "b", 9, "UA", 9, 9)]
    df = spark.createDataFrame(data, "k long, g string, v long, op string, seq long, arrival long")
    stream = feed(spark, df, ["arrival"], str(tmp_path / "in"), chunk) if chunk > 1 else None
    if stream is None:
        runs.stage_in_order(df, str(tmp_path / "in"), ["arrival"], 1, files=1)
        stream = runs.replay_stream(spark, str(tmp_path / "in"), df.schema, 1)
    with keyed_state.rocksdb(spark):
        keyed_state.keep_sums(keyed_state.signed_images(stream, "k", {"g": "string", "v": "long"}), ["g"], {"total": "v"},
                              str(tmp_path / "s"), str(tmp_path / "c"))
    got = keyed_state.kept_sums(spark.read.parquet(str(tmp_path / "s")), ["g"], ["total"])
    assert rows(got, "g", "rows", "total") == [("a", 1, 12), ("b", 1, 9)]


def test_signs_of_a_log_with_both_images(spark):
    log = spark.createDataFrame([("a", 3, "I"), ("a", 3, "UB"), ("a", 4, "UA"), ("b", 1, "I"), ("b", 1, "D"), ("c", 9, "?")],
                                "g string, v long, op string")
    sums = keyed_state.signed_sums(keyed_state.signs_of(log), ["g"], {"total": "v"})
    assert rows(keyed_state.kept_sums(sums, ["g"], ["total"]), "g", "rows", "total") == [("a", 1, 4)]


def test_orders_and_lines_join_as_streams(spark, tmp_path):
    def at(s):
        return f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    orders = [(i, f"u{i}", at(i * 10), i * 7 % 5) for i in range(40) if i % 8 != 3] + [(None, None, "2024-03-01 00:00:00", 999)]
    lines = [(i, 100 * i + k, at(i * 10 + k), i * 3 % 7) for i in range(40) if i % 6 != 1 for k in range(2)] + [
        (None, None, "2024-03-01 00:00:00", 999)]
    left = typed(spark.createDataFrame(orders, "order_id long, user string, sent string, arrival int"), "sent")
    right = typed(spark.createDataFrame(lines, "order_id long, item_id long, sent string, arrival int"), "sent")
    streams = [feed(spark, df, ["arrival"], str(tmp_path / n), 15).drop("arrival") for n, df in (("o", left), ("l", right))]
    both = joined.orders_with_lines(*streams, "sent", "60 seconds", "1 hour")
    runs.append_sink(both, str(tmp_path / "out"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "out")).where("coalesce(order_id, line_order_id) is not null")
    want = left.select("order_id", "user").join(right.select(F.col("order_id").alias("line_order_id"), "item_id"),
                                                F.col("order_id") == F.col("line_order_id"), "full_outer") \
        .where("coalesce(order_id, line_order_id) is not null")
    assert rows(got, "order_id", "item_id", "line_order_id") == rows(want, "order_id", "item_id", "line_order_id")


def test_bursts_on_the_stream(spark, tmp_path):
    seconds = [60 * m + s for m in range(6) for s in range(2)] + [360 + s for s in range(30)] + [60 * 20, 60 * 400]
    df = spark.createDataFrame([(s,) for s in seconds], "s long").select(
        F.timestamp_seconds(F.col("s") + 86_400).cast("timestamp_ntz").alias("ts"), "s")
    stream = feed(spark, df, ["s"], str(tmp_path / "in"), 12)
    runs.append_sink(joined.bursts(stream, "ts", "60 seconds", 5, 10, "120 seconds"), str(tmp_path / "o"), str(tmp_path / "c"))
    got = [(r["rows"], r["usual"], r["burst"]) for r in spark.read.parquet(str(tmp_path / "o")).orderBy("window_start").collect()]
    assert got == [(2, None, 0), *[(2, 2.0, 0)] * 5, (30, 2.0, 1), (1, None, 0)]


def test_row_counts_outlast_the_progress_reports(spark, tmp_path):
    df = spark.range(90).select("id", F.timestamp_seconds(F.col("id") + 86_400).cast("timestamp_ntz").alias("ts"))
    stream = feed(spark, df, ["id"], str(tmp_path / "in"), 6)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        with counts.row_counts(spark, "seen") as listener:
            table = windows.window_table(str(tmp_path / "w"))
            query = windows.window_stream(listener.observe(stream), "ts", "10 seconds", "5 seconds", table, str(tmp_path / "c"))
            assert listener.total(query) == 90 and len(query.recentProgress) <= 3
            with pytest.raises(ValueError):
                windows.dropped_by_watermark(query)
            listener.save(spark, str(tmp_path / "n"))
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert spark.read.parquet(str(tmp_path / "n")).agg(F.sum("rows")).first()[0] == 90


def test_images_are_kept_by_the_bucket(spark, tmp_path):
    """One value of the store holds many keys; nulls, tabs, empty texts and long numbers come back as they were."""
    big = 2**53 + 1
    data = [(k, f"g{k % 3}", big if k % 2 else None, "I", 1, k) for k in range(40)] + [
        (k, "a\tb" if k % 4 else "", big + k, "UA", 2, 40 + k) for k in range(20)] + [
        (k, None, None, "D", 3, 60 + k) for k in range(5)] + [(None, None, big, "I", 1, 70), (3, "late", 1, "UA", 2, 71)]
    df = spark.createDataFrame(data, "k long, g string, v long, op string, seq long, arrival long")
    stream = feed(spark, df, ["arrival"], str(tmp_path / "in"), 24)
    with keyed_state.rocksdb(spark):
        keyed_state.keep_sums(keyed_state.signed_images(stream, "k", {"g": "string", "v": "long"}, 3), ["g"], {"total": "v"},
                              str(tmp_path / "s"), str(tmp_path / "c"))
    got = keyed_state.kept_sums(spark.read.parquet(str(tmp_path / "s")), ["g"], ["total"])
    last = {r[0]: r for r in data if r[3:5] != ("UA", 2) or r[1] != "late"}
    want = {}
    for _k, g, v, op, *_ in last.values():
        if op != "D":
            n, total = want.get(g, (0, None))
            want[g] = (n + 1, total if v is None else (total or 0) + v)
    assert {r["g"]: (r["rows"], r["total"]) for r in got.collect()} == want
    assert spark.read.format("statestore").load(str(tmp_path / "c")).count() <= 3


class CountingHandle:
    """A state handle in memory that counts the words to the store."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, _name, _schema):
        return self

    def _said(self):
        self.calls += 1

    def exists(self):
        self._said()
        return self.value is not None

    def get(self):
        self._said()
        return self.value

    def update(self, value):
        self._said()
        self.value = value

    def listTimers(self):
        self._said()
        return iter(self.timers)

    def registerTimer(self, at):
        self._said()
        self.timers.add(at)

    def deleteTimer(self, at):
        self._said()
        self.timers.discard(at)


def test_a_step_check_speaks_little_to_the_store():
    handle, check = CountingHandle(), keyed_state.StepCheck(1000)
    check.init(handle)

    def batch(*found):
        handle.calls = 0
        return [p for p in check.handleInputRows((1,), iter([pd.DataFrame(found, columns=["seq", "status", "us"])]), None)]
    assert batch((1, "CREATED", 5000), (2, "PAID", 6000)) == [] and handle.calls == 2 and handle.timers == set()
    assert batch((4, "COMPLETED", 9000), (3, "SHIPPED", 8000)) == [] and handle.calls == 3 and handle.timers == {10}
    bad = batch((5, "PAID", 9500))
    assert bad[0].values.tolist() == [[1, 5, "COMPLETED", "PAID"]] and handle.calls == 3 and handle.timers == set()
