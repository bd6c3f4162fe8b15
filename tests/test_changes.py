"""Change-log operators on the cases that go wrong."""

import pytest
from pyspark.sql import functions as F

from helpers import price_log, products, rows, typed
from shoplake.operators import changes as C
from shoplake.operators import filters as O
from shoplake.operators import quality as Q
from shoplake.operators.joins import anchor_probe
from shoplake.operators.sets import diff_tables, missing_keys
from shoplake.sources.ids import assign_ids, split_ranges

T0, T1, T2, T3 = (f"2024-01-0{i} 00:00:00" for i in range(1, 5))


@pytest.fixture(scope="module")
def ties(spark):
    """Two products whose first versions share one instant."""
    return price_log(spark, [
        (1, 1, "10.00", "INIT", T0), (2, 2, "20.00", "INIT", T0), (3, 1, "11.00", "ADJUST", T1),
        (4, 2, "21.00", "ADJUST", T1), (5, 1, "12.00", "ADJUST", T1), (6, 1, "13.00", "ADJUST", T2),
        (7, 2, "22.00", "ADJUST", T2), (8, 2, "23.00", "ADJUST", T3)])


def test_keyset_pages_lose_no_row(ties):
    seen, after = [], None
    while True:
        page = O.keyset_page(ties, after, 3).collect()
        if not page:
            break
        seen += [r["change_id"] for r in page]
        after = (str(page[-1]["change_time"]), page[-1]["change_id"])
    assert seen == [1, 2, 3, 4, 5, 6, 7, 8]


def test_equal_times_are_reported(ties):
    assert rows(C.out_of_order(ties), "change_id") == [(5,)]
    assert rows(Q.time_not_increasing(ties, pieces=2), "change_id") == [(5,)]


def test_noops_are_dropped(spark):
    log = price_log(spark, [(1, 1, "5.00", "INIT", T0), (2, 1, "5.00", "ADJUST", T1), (3, 1, "6.00", "ADJUST", T2),
                            (4, 1, "6.00", "OFFSHELF", T3), (5, 2, "7.00", "INIT", T0), (6, 2, "5.00", "ADJUST", T1)])
    kept = C.suppress_noop(log, "product_id", ["new_price"], ["change_time", "change_id"])
    assert rows(kept, "change_id") == [(1,), (3,), (5,), (6,)]
    assert kept.columns == log.columns


def test_noop_with_nulls(spark):
    log = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, 4), (1, 4, None)], "k long, s long, v int")
    assert rows(C.suppress_noop(log, "k", ["v"], ["s"]), "s") == [(1,), (3,), (4,)]


def test_latest_is_independent_of_arrival_and_repeats(spark):
    events = [(1, "a", "I", 1), (1, "b", "UA", 3), (1, "old", "UB", 3), (2, "x", "I", 2), (2, "x", "D", 4), (3, "z", "I", 5)]
    schema = "k long, v string, op string, seq long"
    want = [(1, "b"), (3, "z")]
    for order in (events, events[::-1], events + events[:2]):
        assert rows(C.latest_per_key(spark.createDataFrame(order, schema), ["k"], ["seq"]), "k", "v") == want
    kept = C.latest_per_key(spark.createDataFrame(events, schema), ["k"], ["seq"], keep_deletes=True)
    assert rows(kept, "k", "op") == [(1, "UA"), (2, "D"), (3, "I")]


def test_collapse_keeps_last_of_chunk(spark):
    log = price_log(spark, [(1, 1, "1.00", "ADJUST", T0), (2, 1, "2.00", "ADJUST", T1), (3, 2, "9.00", "ADJUST", T1),
                            (4, 1, "3.00", "ADJUST", T2), (5, 2, "8.00", "ADJUST", T3)])
    for hot in (None, 2):
        got = C.collapse_per_chunk(log, 3, pieces=hot)
        assert rows(got, "chunk_no", "product_id", "change_id") == [(0, 1, 2), (0, 2, 3), (1, 1, 4), (1, 2, 5)]


def test_old_values_are_rebuilt_and_chain_holds(ties):
    log = C.derive_old_value(ties)
    assert rows(log.where("product_id = 1"), "change_id", "old_price") == [
        (1, None), (3, "10.00"), (5, "11.00"), (6, "12.00")]
    assert Q.price_chain_breaks(log).count() == 0
    assert rows(Q.price_chain_breaks(log.where("change_id <> 5")), "change_id") == [(6,)]


def test_bracketed_changes(spark):
    rows_in = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "k long, seq long, v string")
    assert rows(C.bracket_changes(rows_in, ["k"], "seq"), "k", "op", "v", "change_seq") == [
        (1, "I", "a", 1), (1, "UA", "b", 2), (1, "UB", "a", 2), (2, "I", "c", 3)]


def test_init_rows_precede_the_log(spark):
    log = price_log(spark, [(1, 1, "11.00", "ADJUST", T1), (2, 1, "12.00", "ADJUST", T2)])
    log = log.withColumn("old_price", F.when(F.col("change_id") == 1, F.lit("10.00").cast("decimal(10,2)"))
                         .otherwise(F.lit("11.00").cast("decimal(10,2)")))
    full = C.with_init_rows(log, products(spark, [(1, "12.00", 0, 1), (2, "5.00", 0, 1)]), T0)
    assert rows(full.where("change_type = 'INIT'"), "product_id", "new_price") == [(1, "10.00"), (2, "5.00")]
    assert full.count() == 4


def test_hard_delete_cascades(spark):
    orders = spark.createDataFrame([(1,), (2,)], "order_id long")
    items = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "item_id long, order_id long")
    left, lines, events = C.hard_delete(orders, items, spark.createDataFrame([(1,), (1,)], "order_id long"))
    assert rows(left) == [(2,)] and rows(lines) == [(12, 2)]
    assert rows(events) == [("fact_order", 1, "D"), ("fact_order_item", 10, "D"), ("fact_order_item", 11, "D")]


def test_state_steps(spark):
    times = ["pay_time", "shipping_time", "complete_time", "cancel_time", "update_time"]
    orders = typed(spark.createDataFrame(
        [(i, s, *[None] * 4, T0) for i, s in enumerate(["CREATED", "PAID", "SHIPPED", "COMPLETED", "CANCELLED", "CREATED"])],
        "order_id long, order_status string, " + ", ".join(f"{t} string" for t in times)), *times)
    keys = spark.createDataFrame([(i,) for i in range(5)], "order_id long")
    stepped = rows(C.advance_orders(orders, keys, T1), "order_id", "order_status", "update_time")
    assert stepped == [(0, "PAID", T1), (1, "SHIPPED", T1), (2, "COMPLETED", T1), (3, "COMPLETED", T0),
                       (4, "CANCELLED", T0), (5, "CREATED", T0)]
    stopped = rows(C.cancel_orders(orders, keys, T1), "order_id", "order_status", "cancel_time")
    assert stopped[:3] == [(0, "CANCELLED", T1), (1, "CANCELLED", T1), (2, "SHIPPED", None)]
    assert stopped[5] == (5, "CREATED", None)


def test_deactivate_only_active(spark):
    dim = products(spark, [(1, "5.00", 1, 1), (2, "6.00", 1, 0), (3, "7.00", 1, 1)])
    keys = spark.createDataFrame([(1,), (2,)], "product_id long")
    assert rows(C.deactivate(dim, keys, "product_id", T2), "product_id", "status", "update_time") == [
        (1, 0, T2), (2, 0, T0), (3, 1, T0)]
    assert rows(C.offshelf_log(dim, keys, T2), "product_id", "old_price", "new_price") == [(1, "5.00", "5.00")]
    assert rows(O.active_only(dim), "product_id") == [(1,), (3,)]


def test_adjust_prices_has_floors(spark):
    dim = products(spark, [(1, "5.00", 3, 1), (2, "6.00", 3, 0), (3, "7.00", 3, 1)])
    moves = spark.createDataFrame([(1, "0.40", -9), (2, "9.00", 1)], "product_id long, new_price string, stock_delta int")
    updated, log = C.adjust_prices(dim, moves, T2)
    assert rows(updated, "product_id", "price", "stock") == [(1, "1.00", 0), (2, "6.00", 3), (3, "7.00", 3)]
    assert rows(log, "product_id", "old_price", "new_price", "change_type") == [(1, "5.00", "1.00", "ADJUST")]


def test_guarded_value_map_leaves_noops_alone(spark):
    dim = products(spark, [(1, "5.00", 0, 1), (2, "6.00", 0, 1)])
    updates = typed(spark.createDataFrame([(1, "5.00", T2), (2, "7.00", T2)],
                                          "product_id long, price string, update_time string"), "update_time")
    updates = typed(updates, "price", kind="decimal(10,2)")
    got = O.apply_value_map(dim, updates, "product_id", ["price", "update_time"], guard="price")
    assert rows(got, "product_id", "price", "update_time") == [(1, "5.00", T0), (2, "7.00", T2)]


def test_chunk_stats_count_noops(spark):
    log = price_log(spark, [(1, 1, "5.00", "INIT", T0), (2, 2, "6.00", "INIT", T0), (3, 1, "5.00", "ADJUST", T1),
                            (4, 1, "8.00", "ADJUST", T2)])
    dim = products(spark, [(1, "5.00", 0, 1), (2, "1.00", 0, 1)])
    assert rows(C.chunk_stats(log, dim, 2)) == [(0, 2, 2, 1, 1), (1, 2, 1, 1, 0)]


def test_soft_delete_is_invisible_to_update_time(spark):
    orders = typed(spark.createDataFrame(
        [(1, "CANCELLED", 0, None, T0), (2, "CANCELLED", 0, None, T0), (3, "CANCELLED", 0, None, T2), (4, "PAID", 0, None, T0)],
        "order_id long, order_status string, is_deleted int, deleted_time string, update_time string"),
        "deleted_time", "update_time")
    condition = F.col("order_status") == "CANCELLED"
    gone = O.soft_delete(orders, condition, T3, "order_id", limit=2)
    assert rows(gone, "order_id", "is_deleted", "update_time") == [(1, 1, T0), (2, 1, T0), (3, 0, T2), (4, 0, T0)]
    assert rows(O.incremental_read(gone, T2), "order_id") == [(1,), (2,)]
    assert rows(O.soft_delete(orders, condition, T3, "order_id").where("is_deleted = 1"), "order_id") == [(1,), (2,), (3,)]
    assert rows(O.stale(orders, T2, 60, "CANCELLED"), "order_id") == [(1,), (2,)]
    assert rows(O.oldest_n(orders, 2), "order_id") == [(1,), (2,)]


def test_ids_continue_and_are_contiguous(spark):
    new = spark.createDataFrame([(i % 3, i) for i in range(50)], "t int, k int")
    old = spark.createDataFrame([(7,), (9,)], "order_id long")
    for hot in (None, 6):
        got = assign_ids(new, ["t", "k"], "order_id", after=old, pieces=hot).orderBy("t", "k").collect()
        assert [r["order_id"] for r in got] == list(range(10, 60))
    first = assign_ids(new, ["t", "k"], "order_id", after=old.limit(0))
    assert first.agg(F.min("order_id")).first()[0] == 1


def test_split_ranges(spark):
    assert rows(split_ranges(spark, 10, 4), "start", "end") == [(0, 3), (3, 6), (6, 9), (9, 10)]
    assert rows(split_ranges(spark, 4, 3), "start", "end") == [(0, 2), (2, 4)]
    assert split_ranges(spark, 0, 3).count() == 0


def test_pools_and_picks_repeat(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 4)
    a, b = O.pool(df, 10, "id", 3), O.pool(df.repartition(7), 10, "id", 3)
    assert rows(a, "id") == rows(b, "id") and a.count() == 10
    picks = O.pick_n_per_group(df, ["g"], 3, "id", seed=1)
    again = O.pick_n_per_group(df, ["g"], 3, "id", seed=1, pieces=5)
    assert rows(picks, "g", "id") == rows(again, "g", "id")
    assert [r["count"] for r in picks.groupBy("g").count().collect()] == [3] * 4


@pytest.mark.parametrize("hot", [None, 10])
def test_anchor_probe_against_brute_force(spark, hot):
    keys = [k for k in range(200) if k % 7 < 3]
    anchors = [0, 3, 50, 51, 120, 195, 199, 400]
    got = anchor_probe(spark.createDataFrame([(k,) for k in keys], "order_id long"),
                       spark.createDataFrame([(a,) for a in anchors], "anchor long"), 5, pieces=hot)
    want = [(a, n, k) for a in anchors for n, k in enumerate([k for k in keys if k >= a][:5], 1)]
    assert rows(got) == sorted(want, key=repr)


def test_set_differences(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (3, None)], "k long, v string")
    assert rows(diff_tables(a, b)) == [(1, "x", "left", 1), (2, "y", "left", 1), (3, None, "right", 1)]
    assert diff_tables(a, a).count() == 0
    assert rows(missing_keys(a, b, "k")) == [(2,)]
