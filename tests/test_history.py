"""Price history: versions, point-in-time lookups, coverage."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import price_log, products, rows, typed
from shoplake.operators import quality as Q
from shoplake.operators.changes import with_init_rows
from shoplake.operators.history import asof_join, build_scd2, build_scd2_multi, price_at, scd2_join

T0, T1, T2, T3 = (f"2024-01-0{i} 00:00:00" for i in range(1, 5))


def lines(spark, data):
    return typed(spark.createDataFrame(data, "item_id long, product_id long, create_time string"), "create_time")


def test_versions_follow_the_price_only(spark):
    log = price_log(spark, [(1, 1, "5.00", "INIT", T0), (2, 1, "5.00", "OFFSHELF", T1), (3, 1, "6.00", "ADJUST", T2),
                            (4, 1, "7.00", "ADJUST", T2), (5, 1, "7.00", "ADJUST", T3)])
    assert rows(build_scd2(log)) == [
        (1, "5.00", T0, T2, 0, 1), (1, "7.00", T2, None, 1, 2)]
    assert Q.scd2_breaks(build_scd2(log)).count() == 0


def test_a_version_back_to_the_same_price_at_one_instant_vanishes(spark):
    log = price_log(spark, [(1, 1, "5.00", "INIT", T0), (2, 1, "9.00", "ADJUST", T1), (3, 1, "5.00", "ADJUST", T1)])
    assert rows(build_scd2(log), "price", "price_end_time") == [("5.00", None)]


@pytest.mark.parametrize("hot", [5, None])
def test_random_logs_give_closed_versions(spark, hot):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    data = [(i, rng.choice([1, 1, 1, 2, 3]), f"{rng.randint(1, 4)}.00", "ADJUST",
             str(start + dt.timedelta(minutes=rng.randint(0, 60)))) for i in range(200)]
    scd2 = build_scd2(price_log(spark, data), pieces=hot)
    assert Q.scd2_breaks(scd2, pieces=hot).count() == 0
    want = {}
    for change_id, product, price, _kind, at in sorted(data, key=lambda r: (r[4], r[0])):
        want.setdefault(product, {})[at] = price
    expected = []
    for product, instants in want.items():
        last = None
        for at, price in sorted(instants.items()):
            if price != last:
                expected.append((product, price, at))
            last = price
    assert rows(scd2, "product_id", "price", "price_start_time") == sorted(expected, key=repr)


def test_tracked_attributes_with_nulls(spark):
    log = typed(spark.createDataFrame([(1, "a", None, T0, 1), (1, "a", None, T1, 2), (1, "a", "x", T2, 3), (1, "b", "x", T3, 4)],
                                      "k long, category string, brand string, ts string, seq long"), "ts")
    got = build_scd2_multi(log, "k", ["category", "brand"], "ts", "seq")
    assert rows(got, "category", "brand", "start_time", "end_time") == [
        ("a", "x", T2, T3), ("a", None, T0, T2), ("b", "x", T3, None)]


def test_exact_and_second_lookups(spark):
    log = price_log(spark, [(1, 1, "5.00", "INIT", "2024-01-01 00:00:00.000"), (2, 1, "6.00", "ADJUST", "2024-01-01 10:00:00.400")])
    early = lines(spark, [(1, 1, "2024-01-01 10:00:00.000"), (2, 1, "2024-01-01 10:00:00.400"), (3, 1, "2023-01-01 00:00:00.000")])
    dim = products(spark, [(1, "4.00", 0, 1)])
    assert rows(price_at(early, log, dim), "item_id", "asof_price") == [(1, "5.00"), (2, "6.00"), (3, "4.00")]
    assert rows(price_at(early, log, dim, granularity="second"), "item_id", "asof_price") == [
        (1, "6.00"), (2, "6.00"), (3, "4.00")]


@pytest.mark.parametrize("hot", [4, None])
def test_lookup_equals_interval_join(spark, hot):
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    def at():
        return str(start + dt.timedelta(minutes=rng.randint(0, 300)))
    log = price_log(spark, [(i, rng.choice([1, 1, 2, 3]), f"{rng.randint(1, 30)}.00", "ADJUST", at()) for i in range(60)])
    facts = lines(spark, [(i, rng.choice([1, 1, 2, 4]), at()) for i in range(200)])
    scd2 = build_scd2(log)
    got = scd2_join(facts, scd2, pieces=hot).select("item_id", "version_price", "version_no")
    v = scd2.withColumnRenamed("product_id", "p")
    want = facts.join(v, (F.col("product_id") == F.col("p")) & (F.col("create_time") >= F.col("price_start_time"))
                      & (F.col("price_end_time").isNull() | (F.col("create_time") < F.col("price_end_time"))), "left") \
        .select("item_id", F.col("price").alias("version_price"), "version_no")
    assert rows(got) == rows(want)


def test_versions_with_a_gap_do_not_match_inside_it(spark):
    scd2 = typed(spark.createDataFrame([(1, "5", T0, T1, 1), (1, "6", T2, None, 2)],
                 "product_id long, price string, price_start_time string, price_end_time string, version_no int"),
                 "price_start_time", "price_end_time")
    facts = lines(spark, [(1, 1, "2024-01-01 12:00:00"), (2, 1, "2024-01-02 12:00:00"), (3, 1, T2)])
    assert rows(scd2_join(facts, scd2), "item_id", "version_price") == [(1, "5"), (2, None), (3, "6")]
    assert rows(Q.scd2_breaks(scd2.withColumn("is_current", F.when(F.col("price_end_time").isNull(), 1).otherwise(0)))) \
        == [(1, 1, 0, 1)]


def test_lines_before_the_first_change_need_init_rows(spark):
    log = price_log(spark, [(1, 1, "5.00", "ADJUST", T2), (2, 1, "6.00", "ADJUST", T3), (3, 2, "7.00", "ADJUST", T2)])
    facts = lines(spark, [(1, 1, T1), (2, 1, T2), (3, 2, T1), (4, 2, T3), (5, 3, T3)])
    dim = products(spark, [(1, "6.00", 0, 1), (2, "7.00", 0, 1), (3, "8.00", 0, 1)])
    assert rows(Q.version_coverage(facts, build_scd2(log))) == [(5, 2, 0.4)]
    assert rows(Q.version_coverage(facts, build_scd2(with_init_rows(log, dim, T0)))) == [(5, 5, 1.0)]


def test_price_checks(spark):
    log = price_log(spark, [(1, 1, "5.00", "INIT", T0), (2, 1, "6.00", "ADJUST", T2), (3, 2, "9.00", "INIT", T0)])
    dim = products(spark, [(1, "6.00", 0, 1), (2, "8.00", 0, 1)])
    assert rows(Q.current_price_mismatch(dim, log)) == [(2, "8.00", "9.00")]
    sold = typed(lines(spark, [(1, 1, T1), (2, 1, T3)]).withColumn("unit_price", F.lit("5.00")), "unit_price",
                 kind="decimal(10,2)")
    assert rows(Q.unit_price_mismatch(sold, log, dim), "item_id", "asof_price") == [(2, "6.00")]


def test_asof_ties_take_the_later_sequence(spark):
    right = typed(spark.createDataFrame([(1, T1, 1, "a"), (1, T1, 2, "b")], "k long, ts string, seq long, v string"), "ts")
    left = typed(spark.createDataFrame([(1, T1)], "k long, ts string"), "ts")
    assert rows(asof_join(left, right, "k", "ts", "ts", {"v": "v"}, right_seq="seq"), "v") == [("b",)]
