"""Stock, order life cycle, totals, quantiles, reports and checks."""

import threading
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import products, rows, typed
from shoplake.model import schemas, with_envelope
from shoplake.operators import aggregates as A
from shoplake.operators import quality as Q
from shoplake.operators import status as S
from shoplake.operators import stock as K
from shoplake.operators.joins import first_order, lookup_join, orphans, unmatched_count
from shoplake.plans import ads, dws, warehouse
from shoplake.sources import driver_tables as src

T0, T1, T2, T3 = (f"2024-01-0{i} 00:00:00" for i in range(1, 5))


def test_deductions_stop_at_zero(spark):
    lines = typed(spark.createDataFrame([(1, 10, T0, 3), (1, 11, T1, 1), (1, 11, T1, 3)],
                                        "product_id long, order_id long, order_time string, quantity int"), "order_time")
    dim, log = K.deduct_stock(products(spark, [(1, "1.00", 5, 1), (2, "1.00", 7, 1)]), lines)
    assert rows(log, "order_id", "delta", "stock_after") == [(10, -3, 2), (11, -4, 0)]
    assert rows(dim, "product_id", "stock", "update_time") == [(1, 0, T1), (2, 7, T0)]


@pytest.mark.parametrize("hot", [3, None])
def test_floored_levels_with_mixed_signs(spark, hot):
    deltas = [-3, -9, 4, -2, -5, 10, -1, -20, 1, 1]
    level, want = 5, []
    for i, d in enumerate(deltas):
        level = max(level + d, 0)
        want.append((i, level))
    log = spark.createDataFrame([(1, i, d, 5) for i, d in enumerate(deltas)], "k long, i int, d int, open int")
    assert rows(K.floored_levels(log, "open", "d", "k", ["i"], pieces=hot), "i", "level") == want


@pytest.fixture(scope="module")
def stock_log(spark):
    return typed(spark.createDataFrame([
        (1, 1, 5, 5, "2024-01-01 08:00:00"), (2, 1, -2, 3, "2024-01-01 09:00:00"), (3, 1, -1, 2, "2024-01-01 09:00:00"),
        (4, 1, 8, 10, "2024-01-05 09:00:00"), (5, 2, 1, 1, "2024-01-03 09:00:00")],
        "change_id long, product_id long, delta int, stock_after int, change_time string"), "change_time")


def test_stock_is_carried_over_days_without_change(spark, stock_log):
    dim = products(spark, [(1, "1.00", 0, 1), (2, "1.00", 0, 1)])
    got = rows(K.stock_per_day(dim, stock_log, "2024-01-02", "2024-01-05"))
    assert got == [(1, "2024-01-02", 2, 0, 0), (1, "2024-01-03", 2, 0, 0), (1, "2024-01-04", 2, 0, 0),
                   (1, "2024-01-05", 10, 8, 0), (2, "2024-01-02", None, 0, 0), (2, "2024-01-03", 1, 1, 0),
                   (2, "2024-01-04", 1, 0, 0), (2, "2024-01-05", 1, 0, 0)]
    assert rows(Q.stock_gap(stock_log)) == []
    assert rows(Q.stock_gap(stock_log.where("change_id <> 2")), "product_id", "gap") == [(1, -2)]


def test_days_of_stock_are_made_after_the_last_shuffle(spark, stock_log):
    """Levels from before the span, null levels and products without changes; the dense table meets no exchange and no window."""
    dim = products(spark, [(i, "1.00", 0, 1) for i in (1, 2, 3)])
    log = stock_log.unionByName(typed(spark.createDataFrame(
        [(6, 1, 3, None, "2024-01-06 09:00:00")], "change_id long, product_id long, delta int, stock_after int, change_time string"),
        "change_time"))
    got = K.stock_per_day(dim, log, "2024-01-04", "2024-01-07")
    assert rows(got, "product_id", "day_end_stock", "in_qty") == sorted(
        [(1, 2, 0), (1, 10, 8), (1, 10, 3), (1, 10, 0)] + [(2, 1, 0)] * 4 + [(3, None, 0)] * 4, key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Generate")]
    assert "Join" not in above and "Window" not in above and "Aggregate" not in above


def test_layers_are_written_at_the_same_time(spark, tmp_path, monkeypatch):
    """A table that reads nothing unwritten waits for no other; one that fails ends the build."""
    meet = threading.Barrier(2, timeout=60)

    def load(df, path, plain=warehouse.load_table):
        if path.endswith(("dim_user", "fact_stock_change")) and "/ods/" in path:
            meet.wait()
        if path.endswith("category_rank_day"):
            raise OSError("disk full")
        plain(df, path)
    monkeypatch.setattr(warehouse, "load_table", load)
    sf = "/root/testdata/sf0.001"
    sources = {"dim_user": src.users(spark, sf), "dim_product": src.products(spark, sf), "fact_order": src.orders(spark, sf),
               "fact_order_item": src.items(spark, sf), "fact_product_price_change": src.price_log(spark, sf),
               "fact_stock_change": src.stock_log(spark, sf)}
    with pytest.raises(OSError, match="disk full"):
        warehouse.build(spark, sources, str(tmp_path / "w"), warehouse.Span("2001-08-02", "year"))


def test_layers_leave_no_shuffle_files(spark, tmp_path, monkeypatch):
    """A table's shuffle files go with its job, summaries of all lines follow each other, the session keeps its settings."""
    sf = "/root/testdata/sf0.001"
    sources = {"dim_user": src.users(spark, sf), "dim_product": src.products(spark, sf), "fact_order": src.orders(spark, sf),
               "fact_order_item": src.items(spark, sf), "fact_product_price_change": src.price_log(spark, sf),
               "fact_stock_change": src.stock_log(spark, sf)}

    def shuffle_files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {blocks.apply(i).getName() for i in range(blocks.size())} - {""}
    written = []

    def load(df, path, plain=warehouse.load_table):
        written.append(path)
        plain(df, path)
        written.append(path)
    monkeypatch.setattr(warehouse, "load_table", load)
    before = shuffle_files()
    had = {key: spark.conf.get(key, None) for key in warehouse.SAVING}
    warehouse.build(spark, sources, str(tmp_path / "w"), warehouse.Span("2001-08-02", "year"))
    for _ in range(50):             # files go in the background
        left = {name for name in shuffle_files() - before if name.startswith("shuffle_")}
        if not left:
            break
        time.sleep(0.1)
    assert not left
    lines = [path.rpartition("_")[0] for path in written if path.endswith(("trade_product_day", "trade_category_day"))]
    assert lines == [str(tmp_path / "w/dws/trade_product")] * 2 + [str(tmp_path / "w/dws/trade_category")] * 2
    assert {key: spark.conf.get(key, None) for key in warehouse.SAVING} == had


@pytest.fixture(scope="module")
def life(spark):
    return typed(spark.createDataFrame([
        (1, 1, "CREATED", T0), (1, 4, "COMPLETED", T3), (1, 2, "PAID", T1), (1, 3, "SHIPPED", T2), (1, 3, "SHIPPED", T2),
        (2, 5, "CREATED", T0), (2, 6, "PAID", T1), (2, 7, "SHIPPED", T2), (2, 8, "CANCELLED", T3)],
        "order_id long, seq long, status string, ts string"), "ts")


def test_milestones_ignore_order_and_repeats(spark, life):
    day = 86400
    assert rows(S.with_durations(S.milestones(life)), "order_id", "pay_sec", "ship_sec", "complete_sec") == [
        (1, day, day, day), (2, day, day, None)]
    assert rows(S.milestones(life)) == rows(S.milestones(life.orderBy(F.desc("ts")).dropDuplicates()))


def test_invalid_steps(spark, life):
    got = S.transitions(life.dropDuplicates())
    assert rows(got.where("valid = 0"), "order_id", "from_status", "to_status") == [(2, "SHIPPED", "CANCELLED")]
    other = spark.createDataFrame([(3, 1, "COMPLETED"), (3, 2, "PAID")], "order_id long, seq long, status string")
    assert S.transitions(other).where("valid = 1").count() == 0
    assert rows(S.order_trace(life.dropDuplicates(), "2-"), "step_no", "status") == [
        (1, "CREATED"), (2, "PAID"), (3, "SHIPPED"), (4, "CANCELLED")]


def test_milestone_findings(spark):
    stamps = ["order_time", "pay_time", "shipping_time", "complete_time", "cancel_time"]
    orders = typed(spark.createDataFrame([
        (1, "COMPLETED", T0, T1, T2, T3, None), (2, "PAID", T1, T0, None, None, None), (3, "SHIPPED", T0, T1, None, None, None),
        (4, "CANCELLED", T0, T1, None, None, T2), (5, "CREATED", T0, T1, None, None, None)],
        "order_id long, order_status string, " + ", ".join(f"{s} string" for s in stamps)), *stamps)
    assert rows(Q.milestone_order(orders)) == [(2, "PAID", 1, 0), (3, "SHIPPED", 0, 1), (5, "CREATED", 0, 1)]


def money(df, *columns):
    return typed(df, *columns, kind="decimal(12,2)")


def test_headers_against_lines(spark):
    orders = money(spark.createDataFrame([(1, 3, "10.00", "1.00"), (2, 1, "5.01", "0.00"), (3, 2, "4.00", "0.00")],
                   "order_id long, item_count int, total_amount string, discount_amount string"), "total_amount", "discount_amount")
    items = money(spark.createDataFrame([(1, 1, 2, "6.00", "1.00"), (2, 1, 1, "5.00", "0.00"), (3, 2, 1, "5.00", "0.00"),
                                         (4, 3, 3, "4.00", "0.00"), (4, 9, 1, "1.00", "0.00")],
                  "item_id long, order_id long, quantity int, subtotal string, discount_amount string"), "subtotal", "discount_amount")
    assert rows(Q.header_vs_lines(orders, items)) == [(2, 0, "0.01", "0.00"), (3, -1, "0.00", "0.00")]
    assert rows(Q.orphans_both_ways(orders, items)) == [("line_without_order", 4)]
    assert rows(Q.duplicate_keys(items, ["item_id"])) == [(4, 2)]


def test_lookup_keeps_unknown_products(spark):
    items = spark.createDataFrame([(1, 1), (2, 9)], "item_id long, product_id long")
    looked = lookup_join(items, products(spark, [(1, "1.00", 0, 1)]), ["price"])
    assert rows(looked, "item_id", "matched") == [(1, 1), (2, 0)]
    assert rows(unmatched_count(looked)) == [(2, 1)]


def test_first_order_fills_only_nulls(spark):
    users = typed(spark.createDataFrame([(1, None), (2, T0), (3, None)], "user_id long, first_order_time string"), "first_order_time")
    orders = typed(spark.createDataFrame([(1, 1, T2, "CANCELLED"), (2, 1, T3, "PAID"), (3, 2, T3, "PAID")],
                   "order_id long, user_id long, order_time string, order_status string"), "order_time")
    assert rows(first_order(users, orders)) == [(1, T2), (2, T0), (3, None)]
    assert rows(first_order(users, orders, ["PAID"])) == [(1, T3), (2, T0), (3, None)]
    assert rows(S.flag_new_customer(orders), "order_id", "is_new_customer") == [(1, 1), (2, 0), (3, 1)]


def test_latency_and_throughput(spark):
    probes = spark.range(1, 11).select("id", (F.lit(1_700_000_000_000) + F.col("id") * 500).alias("create_time_ms")) \
        .withColumn("sink_time", F.timestamp_millis(F.col("create_time_ms") + F.col("id") * 100).cast("timestamp_ntz"))
    for hot in (None, 3):
        got = A.latency_stats(probes, 100, pieces=hot).withColumn("p95_ms", F.round("p95_ms", 6))
        assert rows(got) == [(0, 10, 1000, 550.0, 955.0)]
    run = A.throughput(probes, 2.0).first()
    assert (run["rows"], run["first_id"], run["last_id"], run["wall_sec"], run["off_target"]) == (10, 1, 10, 4.5, 1)
    assert A.throughput(probes, 2.2).first()["off_target"] == 0


@pytest.mark.parametrize("n", [1, 3, 5, 12, 103])
def test_quintiles_equal_ntile(spark, n):
    df = spark.range(n).select(F.col("id").alias("user_id"), (F.pmod(F.xxhash64("id"), F.lit(4))).alias("v"))
    want = df.withColumn("q", F.ntile(5).over(Window.orderBy("v", "user_id")))
    assert rows(ads.quintiles(df, {"q": "v"}, "user_id", pieces=20)) == rows(want)


def test_rank_share_and_divergence(spark):
    day = money(spark.createDataFrame([("a", T0, "3.00", "4.00"), ("b", T0, "1.00", "1.00"), ("c", T0, "1.00", "0.50")],
                "category string, dt string, gross_amt string, current_price_amt string"), "gross_amt", "current_price_amt")
    day = day.withColumns({"dt": F.to_date("dt"), "net_amt": F.col("gross_amt")})
    assert rows(ads.category_rank_day(day), "category", "rank", "share") == [("a", 1, 0.6), ("b", 2, 0.2), ("c", 2, 0.2)]
    assert rows(ads.top_k_categories(day, "2024-01-01", 1), "category") == [("a",)]
    assert rows(ads.price_divergence_by_category(day), "category", "diff_ratio") == [
        ("a", 0.333333), ("b", 0.0), ("c", -0.5)]


def test_days_missing_in_one_mart_stay(spark):
    lines = money(spark.createDataFrame([("2024-01-01", "5.00", "4.00")], "dt string, gross_amt string, net_amt string"), "gross_amt", "net_amt")
    buyers = money(spark.createDataFrame([("2024-01-02", "3.00")], "dt string, paid_amt string"), "paid_amt")
    assert rows(ads.gmv_caliber_compare(lines, buyers), "dt", "gross_gmv", "paid_gmv") == [
        ("2024-01-01", "5.00", None), ("2024-01-02", None, "3.00")]


def test_distinct_orders_of_a_category(spark):
    items = money(spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 1)], "category string, order_id long, quantity int")
                  .withColumns({c: F.lit("1.00") for c in ("subtotal", "discount_amount", "net_amount", "current_price_amount")}),
                  "subtotal", "discount_amount", "net_amount", "current_price_amount").withColumn("dt", F.lit("2024-01-01"))
    assert rows(dws.trade_category_day(items), "line_cnt", "qty", "order_cnt") == [(3, 4, 2)]


def test_places_and_domains(spark):
    users = spark.createDataFrame([(1, "north", "alder"), (2, "north", "birch"), (3, "south", "birch")],
                                  "user_id long, province string, city string")
    assert rows(Q.city_outside_province(users, {"north": ["alder"], "south": ["birch"]}), "user_id") == [(2,)]
    kinds = spark.createDataFrame([("ADJUST",), ("FINAL",), (None,)], "change_type string")
    assert rows(Q.outside_domain(kinds, "change_type", ["ADJUST"]), "value", "rows") == [("FINAL", 1), (None, 1)]


def test_removal_drifts_the_cancel_rate(spark):
    orders = spark.createDataFrame([("CANCELLED", int(i < 15)) for i in range(20)] + [("PAID", 0)] * 80,
                                   "order_status string, is_deleted int")
    got = Q.caliber_drift(orders).first()
    assert (got["cancel_rate"], got["cancel_rate_after_removal"]) == (0.2, round(5 / 85, 6))


def test_update_time_going_back(spark):
    log = typed(spark.createDataFrame([(1, 1, T1), (1, 2, T0), (1, 3, T3)], "k long, seq long, update_time string"), "update_time")
    assert rows(Q.update_time_regressions(log, "k", "seq"), "seq") == [(2,)]


def test_completeness_and_grid(spark):
    a, b = spark.range(5).toDF("k"), spark.range(3).toDF("k")
    assert rows(Q.replay_completeness(a, b, "k")) == [(5, 3, 2, 0)]
    mart = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "c string, d int")
    assert rows(Q.grid_coverage(mart, "c", "d")) == [(3, 2, 2, 1, 0)]


def test_schemas_carry_comments():
    for table in schemas().values():
        assert all(f.metadata["comment"] for f in table.fields)
    assert with_envelope(schemas()["dim_user"]).names[-3:] == ["op", "seq", "arrival"]


def test_orphans_hold_parent_keys_only(spark):
    """Lines pass by unsorted in parts whose number follows the rows; null keys have no parent, a heavy key has."""
    orders = spark.createDataFrame([(i,) for i in range(50) if i % 7] + [(None,), (3,)], "order_id long")
    lines = spark.createDataFrame([(i, i % 60) for i in range(300)] + [(1000 + i, 1) for i in range(500)] + [(9999, None)],
                                  "item_id long, order_id long")
    lost = orphans(lines, orders, "order_id")
    plan = lost._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert "REPARTITION_BY_NUM" in plan
    assert {r["item_id"] for r in lost.collect()} == {i for i in range(300) if i % 60 % 7 == 0 or i % 60 >= 50} | {9999}
    none = orphans(orders, lines.where("order_id <> 3"), "order_id")
    assert sorted((r["order_id"] or -1) for r in none.collect()) == [-1, 3, 3]
