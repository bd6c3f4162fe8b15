"""Ordered scans give the same answer whether or not a key is split."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shoplake.operators.ordered import exact_quantiles, ordered_scan, in_segments


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        key = 1 if rng.random() < 0.4 else rng.randint(2, 9)
        value = None if rng.random() < 0.3 else rng.randint(0, 50)
        rows.append((key, rng.randint(0, 40), i, value))
    return spark.createDataFrame(rows, "k long, t int, id long, v int").cache()


@pytest.mark.parametrize("pieces", [1, 3, 40])
@pytest.mark.parametrize("keys", [["k"], []])
def test_scan_equals_plain_window(log, keys, pieces):
    got = ordered_scan(log, keys, ["t", "id"], previous={"pv": "v", "pid": "id"},
                       following={"nid": "id"}, running={"sv": "v"}, peak_before={"mv": "v"},
                       filled={"fv": "v"}, number="rn", pieces=pieces)
    w = Window.partitionBy(*keys).orderBy("t", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = log.select(
        "*", F.lag("v").over(w).alias("pv"), F.lag("id").over(w).alias("pid"),
        F.lead("id").over(w).alias("nid"),
        F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("sv"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("mv"),
        F.last("v", True).over(upto).alias("fv"), F.row_number().over(w).alias("rn"))
    columns = sorted(want.columns)
    assert sorted(map(repr, got.select(*columns).collect())) == \
        sorted(map(repr, want.select(*columns).collect()))


def test_heavy_keys_ties_and_nulls_are_cut(spark, log):
    parts = in_segments(log, ["k"], ["t", "id"], pieces=10)
    sizes = [r["n"] for r in parts.where("k = 1").groupBy("_segment").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 4 and max(sizes) <= 200
    same = spark.range(2000).select(F.lit(None).cast("long").alias("k"), F.lit(1).alias("t"), "id")
    sizes = [r["count"] for r in in_segments(same, ["k"], ["t"], pieces=8).groupBy("_segment").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 600
    numbered = ordered_scan(same, ["k"], ["t"], number="n", pieces=8)
    assert sorted(r["n"] for r in numbered.collect()) == list(range(1, 2001))


@pytest.mark.parametrize("pieces", [1, 5])
def test_exact_quantiles(log, pieces):
    got = exact_quantiles(log, ["k"], "v", {"p50": 0.5, "p95": 0.95}, pieces=pieces)
    want = log.groupBy("k").agg(F.percentile("v", 0.5).alias("p50"), F.percentile("v", 0.95).alias("p95"))
    a = {r["k"]: (round(r["p50"], 9), round(r["p95"], 9)) for r in got.collect()}
    b = {r["k"]: (round(r["p50"], 9), round(r["p95"], 9)) for r in want.collect()}
    assert a == b


def test_scan_of_nothing(spark):
    empty = spark.createDataFrame([], "k long, t int, v int")
    assert ordered_scan(empty, [], ["t"], number="n").count() == 0
