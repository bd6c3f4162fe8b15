"""Ranges, text fields, files, keyed tables, JDBC options."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import rows
from shoplake.functions import scalars as X
from shoplake.functions.idranges import (
    OPEN_END, RangeSyntaxError, id_range_filter, in_ranges, merge_intervals, parse_ranges, range_size, ranges_frame)
from shoplake.sources import jdbc
from shoplake.sources.keyed import KeyedTable
from shoplake.sources.batches import append_changes
from shoplake.sources.lake import by_date, load_table, mirror_table, write_bucketed, write_partitioned
from shoplake.sources import tsv
from shoplake.sources.tsv import read_tsv, write_tsv


@pytest.mark.parametrize("text, want", [
    ("1,5,10-20,21-30,100-", [(1, 1), (5, 5), (10, 30), (100, OPEN_END)]), ("-7", [(1, 7)]), ("", []), (None, []),
    (" 3 , 2,1 ", [(1, 3)]), ("5-9,7-8", [(5, 9)])])
def test_parse(text, want):
    assert parse_ranges(text) == want


@pytest.mark.parametrize("text", ["9-3", "x", "1-x", "0", "1.5", "1-2-3"])
def test_bad_ranges_raise(text):
    with pytest.raises(RangeSyntaxError):
        parse_ranges(text)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 20)), max_size=8))
def test_parsed_ranges_cover_the_same_ids(spans):
    text = ",".join(f"{a}-{a + n}" for a, n in spans)
    covered = {i for lo, hi in parse_ranges(text) for i in range(lo, hi + 1)}
    assert covered == {i for a, n in spans for i in range(a, a + n + 1)}


def test_range_filter_and_size(spark):
    ids = spark.range(1, 200)
    want = [(i,) for i in range(1, 200) if i in (1, 5) or 10 <= i <= 30 or i >= 190]
    assert sorted(rows(ids.where(id_range_filter("1,5,10-20,21-30,190-", "id")))) == want
    assert ids.where(id_range_filter("", "id")).count() == 199
    assert rows(range_size(ranges_frame(spark, "1,5,10-30"))) == [("23",)]
    assert rows(range_size(ranges_frame(spark, "1,100-"))) == [(str(OPEN_END - 98),)]
    big = spark.createDataFrame([(2 ** 53 + 5,), (99,)], "id long")
    assert rows(in_ranges(big, ranges_frame(spark, "100-"), "id")) == [(2 ** 53 + 5,)]


@pytest.mark.parametrize("hot", [4, None])
def test_merge_and_membership_by_brute_force(spark, hot):
    rng = random.Random(2)
    spans = [(a := rng.randint(1, 300), a + rng.randint(0, 6)) for _ in range(60)]
    covered = {i for lo, hi in spans for i in range(lo, hi + 1)}
    frame = spark.createDataFrame(spans, "lo long, hi long")
    merged = merge_intervals(frame, pieces=hot)
    assert rows(merged) == sorted(parse_ranges(",".join(f"{a}-{b}" for a, b in spans)), key=repr)
    got = in_ranges(spark.range(1, 320), frame, "id", pieces=hot)
    assert {r[0] for r in rows(got)} == covered & set(range(1, 320))


TEXTS = [None, "", "a\tb", "line\nbreak", "back\\slash", "\\N", "a\\tb", "\r\n", "\\\\", "\u0001\\t\t", "\u0001", "\\"]


def test_tsv_round_trip(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("s", T.StringType()),
                           T.StructField("d", T.DecimalType(10, 2)), T.StructField("t", T.TimestampNTZType())])
    df = spark.createDataFrame([(i, s) for i, s in enumerate(TEXTS)], "id long, s string").withColumns({
        "d": F.when(F.col("id") > 2, F.col("id").cast("decimal(10,2)")),
        "t": F.when(F.col("id") > 3, F.lit("2024-01-01 10:00:00.123").cast("timestamp_ntz"))})
    write_tsv(df, str(tmp_path / "t"), shards=3)
    back = read_tsv(spark, str(tmp_path / "t"), schema)
    assert rows(back) == rows(df) and back.schema == schema
    raw = sorted(r[0] for r in spark.read.text(str(tmp_path / "t")).collect())
    assert "0\t\\N\t\\N\t\\N" in raw and "1\t\t\\N\t\\N" in raw


def test_shards_grow_with_the_rows(spark, tmp_path, monkeypatch):
    assert [tsv.shard_count(n, 4) for n in (0, 4_000_000, 4_000_001, 216_000_000)] == [4, 4, 8, 216]
    monkeypatch.setattr(tsv, "SHARD_ROWS", 10)
    write_tsv(spark.range(90), str(tmp_path / "t"), shards=4)
    files = spark.read.text(str(tmp_path / "t")).groupBy(F.input_file_name()).count().collect()
    assert len(files) == 12 and max(r["count"] for r in files) <= 10


def test_rows_by_year_are_not_shuffled(spark, tmp_path):
    """By day they are, so that a day is not a small file of every task."""
    df = spark.range(0, 90, 1, 3).withColumn("t", F.expr("timestamp_ntz'2023-06-01' + make_dt_interval(cast(id * 10 as int))"))

    def plan(grain):
        return by_date(df, "t", "part", grain)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan("year") and "Exchange" in plan("day")
    write_partitioned(df, path := str(tmp_path / "y"), "t", "part", grain="year")
    got = spark.read.parquet(path)
    assert rows(got.groupBy("part").count()) == rows(df.groupBy(F.trunc("t", "year")).count())
    assert got.select(F.input_file_name()).distinct().count() <= 3 * 3


def test_reload_and_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 10:00:00") for i in range(30)], "id long, t string") \
        .withColumn("t", F.col("t").cast("timestamp_ntz"))
    for _ in range(2):
        write_partitioned(df, path, "t", sort_by=["id"])
    assert spark.read.parquet(path).count() == 30
    write_partitioned(df.where("id = 0"), path, "t")       # replaces one day only
    assert spark.read.parquet(path).count() == 21
    one_day = spark.read.parquet(path).where("order_date = '2024-01-02'")
    assert "PartitionFilters: [isnotnull(order_date" in one_day._jdf.queryExecution().toString()
    load_table(df, str(tmp_path / "l"))
    load_table(df, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 30


def test_bucketed_join_has_no_exchange(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        write_bucketed(spark.range(1000), "bucket_a", 4, "id")
        write_bucketed(spark.range(500, 1500), "bucket_b", 4, "id", str(tmp_path / "b"))
        joined = spark.table("bucket_a").join(spark.table("bucket_b"), "id")
        assert joined.count() == 500
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keyed_table_is_idempotent_and_order_safe(spark, tmp_path):
    schema = "k long, v string, op string, seq long"
    batches = [[(1, "a", "I", 1), (2, "b", "I", 2)], [(1, "c", "UA", 5), (2, "b", "D", 4)], [(1, "late", "UA", 3), (3, "d", "I", 6)]]
    want = [(1, "c"), (3, "d")]
    for name, order in (("x", [0, 1, 2]), ("y", [2, 0, 1, 0, 2]), ("z", [1, 2, 0])):
        table = KeyedTable(str(tmp_path / name), T._parse_datatype_string(schema), ["k"], ["seq"])
        assert table.current(spark).count() == 0
        for n in order:
            table.append(spark.createDataFrame(batches[n], schema), n)
        assert rows(table.current(spark), "k", "v") == want
        assert table.compact(spark) == ("000001-direct", 2)
        assert rows(table.current(spark), "k", "v") == want
        table.append(spark.createDataFrame([(2, "ghost", "UA", 3)], schema), 3)      # older than its delete
        assert rows(table.current(spark), "k", "v") == want
        assert rows(table.current(spark, before=("000001-direct", 3)), "k", "v") == want


def test_append_of_the_same_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "a")
    for n in (0, 1, 1):
        append_changes(spark.range(n * 10, n * 10 + 10), path, n)
    assert spark.read.parquet(path).count() == 20


def test_mirror_copies_only_new_files(spark, tmp_path):
    lake, copy, marks = (str(tmp_path / n) for n in ("lake", "copy", "marks"))
    spark.range(5).write.parquet(lake)
    assert mirror_table(spark, lake, copy, marks).count() == 5
    spark.range(5, 8).write.mode("append").parquet(lake)
    assert mirror_table(spark, lake, copy, marks).count() == 8


def test_jdbc_options():
    read = jdbc.read_options("jdbc:x", "t", "id", 1, 100, 8)
    assert (read["partitionColumn"], read["lowerBound"], read["upperBound"], read["numPartitions"]) == ("id", "1", "100", "8")
    assert jdbc.write_options("jdbc:x", "t", 500)["batchsize"] == "500"


def test_scalars(spark):
    one = spark.range(1)
    def value(column):
        return str(one.select(column.alias("v")).first()["v"])
    assert value(X.to_cents(F.lit("12.345").cast("decimal(10,3)"))) == "1235"
    assert value(X.from_cents(F.lit(1234))) == "12.34"
    assert value(X.format_ts(F.lit(0), "+08:00")) == "1970-01-01 08:00:00.000"
    assert value(X.parse_ts(F.lit("1970-01-01T08:00:00.500+08:00"))) == "500"
    assert value(X.day_index(F.lit("1969-12-31 23:00:00").cast("timestamp_ntz"), 0)) == "-1"
    assert value(X.ratio(F.lit(1), F.lit(0))) == "None"
    assert value(X.label("P", F.lit(7), 4)) == "P0007" and value(X.label("P", F.lit(12345), 4)) == "P12345"
    assert [value(X.price_band(F.lit(p))) for p in (99, 100, 1000, 5000)] == ["0-100", "100-1000", "1000-5000", "5000+"]
    assert [value(X.age_class(F.lit(d))) for d in (0.5, 2, 5, 10, 20)] == ["today", ">1", ">3", ">7", ">14"]
    assert value(X.is_valid_phone(F.lit("13812345678"))) == "True" and value(X.is_valid_phone(F.lit("12812345678"))) == "False"
