"""Tables by order day: what a query of some days reads."""

from pyspark.sql import functions as F

from helpers import typed
from shoplake.registry.source_queries import store_by_order_date, week_of_lines
from shoplake.sources.lake import bucket_count


def test_a_week_reads_its_folders_only(spark, tmp_path):
    orders = typed(spark.createDataFrame([(i, f"2024-01-{1 + i % 28:02d} 10:00:00") for i in range(100)],
                                         "order_id long, order_time string"), "order_time")
    lines = spark.createDataFrame([(i * 10 + k, i, "2.50") for i in range(100) for k in range(i % 3)],
                                  "item_id long, order_id long, subtotal string").withColumn("subtotal", F.col("subtotal").cast("decimal(12,2)"))
    stored = store_by_order_date(spark, orders, lines, str(tmp_path))
    got = week_of_lines(*stored, 2024, 2)
    plan = got._jdf.queryExecution().executedPlan().toString().lower()
    assert plan.count("dynamicpruning") >= 2
    assert {str(r["order_date"]) for r in got.collect()} == {f"2024-01-{d:02d}" for d in range(8, 15)}
    one = stored[1].where("order_date = date'2024-01-09'")
    assert "PartitionFilters: [isnotnull(order_date" in one._jdf.queryExecution().executedPlan().toString()
    assert {f.split("order_date=")[1].split("/")[0] for f in one.inputFiles()} >= {"2024-01-09"}
    assert one.count() == lines.join(orders, "order_id").where("day(order_time) = 9").count()


def test_buckets_grow_with_the_rows():
    assert [bucket_count(n) for n in (0, 1, 16_000_001, 10**9)] == [8, 8, 9, 500]
