"""Streams end where the batch form does, however the input is split."""

import pytest
from pyspark.sql import functions as F

from helpers import price_log, rows, typed
from shoplake.operators.changes import latest_per_key
from shoplake.operators.history import build_scd2
from shoplake.operators.status import milestones, transitions, with_durations
from shoplake.sources.keyed import KeyedTable
from shoplake.streaming import runs, tables, windows

T0, T1, T2, T3 = (f"2024-01-0{i} 00:00:00" for i in range(1, 5))


def feed(spark, df, order, path, chunk):
    runs.stage_in_order(df, path, order, chunk)
    return runs.replay_stream(spark, path, df.schema)


@pytest.mark.parametrize("chunk", [2, 5])
def test_upserts_with_deletes_in_any_order(spark, tmp_path, chunk):
    data = [(1, "a", "I", 1, 4), (1, "b", "UA", 5, 1), (2, "x", "I", 2, 2), (2, "x", "D", 6, 3), (3, "y", "I", 3, 5),
            (3, "z", "UA", 4, 0), (1, "a", "I", 1, 6)]
    df = spark.createDataFrame(data, "k long, v string, op string, seq long, arrival long")
    table = KeyedTable(str(tmp_path / "t"), df.schema, ["k"], ["seq"])
    stream = feed(spark, df, ["arrival"], str(tmp_path / "in"), chunk)
    tables.upsert_stream(stream, table, str(tmp_path / "c"))
    assert rows(table.current(spark), "k", "v") == [(1, "b"), (3, "z")] == rows(latest_per_key(df, ["k"], ["seq"]), "k", "v")
    assert len(table.batches(spark)) == -(-len(data) // chunk)


def test_versions_with_replayed_and_late_changes(spark, tmp_path):
    log = price_log(spark, [(1, 1, "5.00", "INIT", T0), (3, 1, "7.00", "ADJUST", T2), (2, 1, "6.00", "ADJUST", T1),
                            (3, 1, "7.00", "ADJUST", T2), (4, 2, "9.00", "INIT", T0), (1, 1, "5.00", "INIT", T0)])
    ordered = log.withColumn("arrival", F.xxhash64("change_id", "new_price"))
    stream = feed(spark, ordered, ["arrival", "change_id"], str(tmp_path / "in"), 2).drop("arrival")
    tables.scd2_stream(stream, str(tmp_path / "s"), str(tmp_path / "c"))
    assert rows(tables.scd2_versions(spark, str(tmp_path / "s"))) == rows(build_scd2(log))


def test_order_snapshot(spark, tmp_path):
    log = typed(spark.createDataFrame([
        (1, 4, "COMPLETED", T3), (1, 1, "CREATED", T0), (1, 2, "PAID", T1), (1, 3, "SHIPPED", T2), (1, 3, "SHIPPED", T2),
        (2, 5, "CREATED", T0), (2, 6, "CANCELLED", T1)], "order_id long, seq long, status string, ts string"), "ts")
    stream = feed(spark, log, ["seq", "status"], str(tmp_path / "in"), 3)
    tables.acc_stream(stream, str(tmp_path / "a"), str(tmp_path / "c"))
    assert rows(tables.acc_snapshot(spark, str(tmp_path / "a"))) == rows(with_durations(milestones(log)))


def test_invalid_steps_across_batches(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "CREATED"), (2, 2, "CREATED"), (1, 3, "PAID"), (2, 4, "SHIPPED"), (1, 5, "SHIPPED"),
                                 (1, 6, "CANCELLED"), (3, 7, "PAID")], "order_id long, seq long, status string")
    stream = feed(spark, log, ["seq"], str(tmp_path / "in"), 2)
    tables.invalid_transition_stream(stream, str(tmp_path / "o"), str(tmp_path / "c"))
    want = transitions(log).where("valid = 0").select("order_id", "seq", "from_status", "to_status")
    assert rows(tables.invalid_transitions(spark, str(tmp_path / "o"))) == rows(want)


@pytest.mark.parametrize("late_every", [0, 50, 20])
def test_late_rows_are_counted(spark, tmp_path, late_every):
    """0, 2 and 5 % late rows of up to 60 s against a 5 s watermark."""
    rows_in = spark.range(200).select(
        "id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).cast("timestamp_ntz").alias("ts"))
    behind = F.when(F.pmod("id", F.lit(late_every or 1)) == 7, 60).otherwise(0) if late_every else F.lit(0)
    rows_in = rows_in.withColumn("arrival", F.col("id") + behind)
    split = windows.split_late(rows_in.withColumn("arrival", F.col("arrival") * 300 + F.col("id")), "arrival", "ts", 5)
    expected = 200 // late_every if late_every else 0
    assert split.where("late = 1").count() == expected
    assert windows.split_late(rows_in.withColumn("arrival", F.col("arrival") * 300 + F.col("id")), "arrival", "ts", 5,
                              pieces=30).where("late = 1").count() == expected
    stream = feed(spark, rows_in, ["arrival", "id"], str(tmp_path / "in"), 20)
    table = windows.window_table(str(tmp_path / "w"))
    query = windows.window_stream(stream, "ts", "10 seconds", "5 seconds", table, str(tmp_path / "c"))
    kept = table.current(spark).agg(F.sum("rows")).first()[0]
    if not late_every:
        assert kept == 200 and windows.dropped_by_watermark(query) == 0
    else:
        assert kept < 200 and windows.dropped_by_watermark(query) > 0


def test_repeats_are_dropped(spark, tmp_path):
    df = spark.createDataFrame([(i % 6, T0, i) for i in range(12)], "change_id long, ts string, arrival int")
    stream = feed(spark, typed(df, "ts"), ["arrival"], str(tmp_path / "in"), 4)
    runs.append_sink(windows.drop_repeats(stream, "change_id", "ts", "1 hour"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert rows(spark.read.parquet(str(tmp_path / "o")), "change_id") == [(i,) for i in range(6)]


def test_bursts(spark):
    base = [(60 * m + s,) for m in range(6) for s in range(2)] + [(60 * 6 + s,) for s in range(30)]
    df = spark.createDataFrame(base, "s long").select(F.timestamp_seconds("s").alias("ts"))
    got = windows.window_rates(df, "ts", 60, 2 / 60, 5, 10)
    assert [r["burst"] for r in got.orderBy("window_start").collect()] == [0, 0, 0, 0, 0, 0, 1]


def test_snapshot_then_stream(spark, tmp_path):
    schema = "k long, v string, op string, seq long"
    events = spark.createDataFrame([(1, "a", "I", 1), (1, "b", "UA", 2), (2, "c", "I", 3), (1, "b", "D", 4)], schema)
    snapshot = spark.createDataFrame([(1, "b", "I", 2), (9, "kept", "I", 0)], schema)
    table = KeyedTable(str(tmp_path / "t"), events.schema, ["k"], ["seq"])
    tables.backfill_then_follow(spark, snapshot, feed(spark, events, ["seq"], str(tmp_path / "in"), 2), table, str(tmp_path / "c"))
    assert rows(table.current(spark), "k", "v") == [(2, "c"), (9, "kept")]
    table.compact(spark)
    assert rows(table.current(spark), "k", "v") == [(2, "c"), (9, "kept")]


def test_stateful_snapshot_matches_batch(spark, tmp_path):
    log = typed(spark.createDataFrame([(1, "CREATED", T0), (1, "PAID", T1), (2, "CREATED", T1)],
                                      "order_id long, status string, ts string"), "ts")
    runs.stage_in_order(log, str(tmp_path / "in"), ["ts", "order_id"], 2)
    stream = runs.replay_stream(spark, str(tmp_path / "in"), log.schema)
    state = tables.acc_stateful(stream, "30 days")
    seen = []
    runs.run(state.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(b.collect())), str(tmp_path / "c"))
    last = {r["order_id"]: r for r in seen}
    assert str(last[1]["pay_time"]) == T1 and last[2]["pay_time"] is None


def two_runs(spark, df, order, tmp_path, start):
    """The halves of `df` as two streams with fresh checkpoints; the first stream's last batch is then done again."""
    half = df.count() // 2
    ranked = df.orderBy(*order).collect()
    for k, part in enumerate((ranked[:half], ranked[half:])):
        stream = feed(spark, spark.createDataFrame(part, df.schema), order, str(tmp_path / f"in{k}"), 2)
        start(stream, str(tmp_path / f"c{k}"))


def test_a_new_run_overwrites_nothing(spark, tmp_path):
    schema = "k long, v string, op string, seq long"
    events = spark.createDataFrame([(i, f"v{i}", "I", i) for i in range(8)] + [(1, "new", "UA", 9)], schema)
    table = KeyedTable(str(tmp_path / "t"), events.schema, ["k"], ["seq"])
    two_runs(spark, events, ["seq"], tmp_path, lambda stream, c: tables.upsert_stream(stream, table, c))
    assert rows(table.current(spark), "k", "v") == rows(latest_per_key(events, ["k"], ["seq"]), "k", "v")
    assert len({run for run, _ in table.batches(spark)}) == 2
    again = events.where("seq >= 8")
    first = table.batches(spark)
    table.append(again, first[-1][1], first[-1][0].split("-", 1)[1])       # the same batch once more
    assert table.batches(spark) == first and rows(table.current(spark), "k", "v")[1] == (1, "new")


def test_versions_over_two_runs(spark, tmp_path):
    log = price_log(spark, [(1, 1, "5.00", "INIT", T0), (2, 2, "6.00", "INIT", T0), (3, 1, "7.00", "ADJUST", T2),
                            (4, 1, "8.00", "ADJUST", T3), (5, 1, "6.00", "ADJUST", T1), (6, 3, "1.00", "INIT", T1)])
    two_runs(spark, log, ["change_id"], tmp_path, lambda stream, c: tables.scd2_stream(stream, str(tmp_path / "s"), c))
    assert rows(tables.scd2_versions(spark, str(tmp_path / "s"))) == rows(build_scd2(log))


def test_order_snapshot_and_steps_over_two_runs(spark, tmp_path):
    log = typed(spark.createDataFrame([
        (1, 1, "CREATED", T0), (2, 2, "CREATED", T0), (1, 3, "PAID", T1), (2, 4, "SHIPPED", T1), (1, 5, "SHIPPED", T2), (1, 6, "PAID", T3)],
        "order_id long, seq long, status string, ts string"), "ts")
    two_runs(spark, log, ["seq"], tmp_path, lambda stream, c: tables.acc_stream(stream, str(tmp_path / "a"), c))
    assert rows(tables.acc_snapshot(spark, str(tmp_path / "a"))) == rows(with_durations(milestones(log)))
    steps = tmp_path / "steps"
    two_runs(spark, log.drop("ts"), ["seq"], steps, lambda stream, c: tables.invalid_transition_stream(stream, str(tmp_path / "o"), c))
    want = transitions(log).where("valid = 0").select("order_id", "seq", "from_status", "to_status")
    assert rows(tables.invalid_transitions(spark, str(tmp_path / "o"))) == rows(want)


def test_a_batch_of_changes_reads_the_folders_of_its_products(spark, tmp_path):
    log = price_log(spark, [(i, i % 40, "5.00", "INIT", T0) for i in range(1, 200)])
    placed = log.withColumn("bucket", tables.product_bucket())
    key = tables.batches.write_batch(placed, str(tmp_path / "h"), "r", 0, ("bucket",))
    touched = placed.where("product_id = 7").select("product_id", "bucket").distinct()
    got = tables.touched_history(spark, str(tmp_path / "h"), placed.schema, touched, key)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert got.count() == log.where("product_id = 7").count()


@pytest.mark.parametrize("chunk, files", [(4, 2), (7, 3), (30, 5), (100, 2)])
def test_staging_cuts_chunks_exactly_and_sorts_keys_only(spark, tmp_path, chunk, files):
    """Rows that are equal throughout lie on both sides of cuts; null times come first."""
    data = [(None, 1)] * 3 + [(5, 2)] * 11 + [(5, 3), (6, None), (6, 1)] + [(9 + i // 2, i) for i in range(13)]
    df = spark.createDataFrame(data, "at long, v long").withColumn("text", F.lit("wide")).repartition(5)
    path = str(tmp_path / "in")
    assert runs.stage_in_order(df, path, ["at"], chunk, files) == -(-len(data) // chunk)
    found = spark.read.parquet(f"{path}/feed")
    ranked = sorted(r[0] or -1 for r in data)
    got = {}
    for r in found.collect():
        got.setdefault(r["chunk"], []).append(r["at"] or -1)
    assert {n: sorted(x) for n, x in got.items()} == {n: ranked[n * chunk:(n + 1) * chunk] for n in range(-(-len(data) // chunk))}
    assert rows(found, "at", "v") == rows(df, "at", "v")
    for n in got:
        assert len(runs._file_times(spark, f"{path}/feed/chunk={n}")) == files
    assert [f.name for f in (tmp_path / "in").iterdir() if f.name not in ("feed", "_cuts")] == []
    assert "text" not in spark.read.parquet(f"{path}/_cuts/keys").columns


def test_staging_sorts_only_keys_about_the_cuts_where_rows_are_many(spark, tmp_path, monkeypatch):
    """With copies on both sides of a cut; where one key fills a stretch, and a sample that misleads, places stay exact."""
    monkeypatch.setattr(runs, "SAMPLED", 2_000)
    df = spark.range(30_000).select((F.col("id") * 7919 % 30_000).alias("at")).repartition(5)
    heavy = df.select(F.when(F.col("at").between(7_000, 16_000), 7_000).when(F.col("at") > 100, F.col("at")).alias("at"))
    for name, rows_in in {"plain": df, "heavy": heavy}.items():
        path = str(tmp_path / name)
        assert runs.stage_in_order(rows_in, path, ["at"], 7_500) == 4
        ranked = sorted(-1 if r[0] is None else r[0] for r in rows_in.collect())
        got = {}
        for r in spark.read.parquet(f"{path}/feed").collect():
            got.setdefault(r["chunk"], []).append(-1 if r["at"] is None else r["at"])
        assert {n: sorted(x) for n, x in got.items()} == {n: ranked[n * 7_500:(n + 1) * 7_500] for n in range(4)}
        sorted_keys = spark.read.parquet(f"{path}/_cuts/keys").count()
        assert sorted_keys < {"plain": 15_000, "heavy": 25_000}[name]
    monkeypatch.setattr(runs, "_keys", lambda d, order, make=runs._keys: make(d.where("at < 9000"), order))
    assert runs._near(df, ["at"], str(tmp_path / "misled"), range(7_500, 30_000, 7_500), 30_000) is None
