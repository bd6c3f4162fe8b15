"""Merged sketches against exact results, beyond the size up to which they are exact."""

from pyspark.sql import functions as F

from shoplake.operators import sketches as S


def test_united_distinct_counts_keep_their_error(spark):
    rows = spark.range(300_000).select((F.col("id") % 20).alias("day"), (F.col("id") * 7919 % 90_000).alias("key"))
    days = S.distinct_sketches(rows.unionByName(spark.createDataFrame([(3, None)], "day long, key long")), ["day"], "key")
    weeks = S.united(days, {"week": F.floor(F.col("day") / 5)})
    exact = {r["week"]: r["n"] for r in rows.groupBy(F.floor(F.col("day") / 5).alias("week"))
             .agg(F.count_distinct("key").alias("n")).collect()}
    for r in weeks.select("week", S.estimate("keys").alias("n")).collect():
        assert exact[r["week"]] > 1 << S.LG_ENTRIES and abs(r["n"] - exact[r["week"]]) <= 3 * exact[r["week"]] / 128
    assert S.united(days.limit(0), {"week": F.col("day")}).count() == 0


def test_shared_keys_of_two_sketches(spark):
    rows = spark.range(2000).select(F.lit(1).alias("g"), "id").unionByName(spark.range(500, 3000).select(F.lit(2).alias("g"), "id"))
    both = S.distinct_sketches(rows, ["g"], "id")
    one, two = (both.where(f"g = {g}").select(F.col("keys").alias(f"k{g}"), F.lit(1).alias("j")) for g in (1, 2))
    assert one.join(two, "j").select(S.in_both("k1", "k2").alias("n")).first()["n"] == 1500


def test_merged_quantiles_keep_their_rank_error(spark):
    rows = spark.range(100_000).select(F.floor(F.col("id") / 5000).alias("part"), (F.col("id") * 7919 % 100_003).alias("v"))
    kept = S.quantile_sketches(rows, ["part"], "v")
    got = S.merged_quantiles(kept, {"half": F.floor(F.col("part") / 10)}, {"p10": 0.1, "p50": 0.5, "p99": 0.99})
    for r in got.collect():
        own = rows.where(F.floor(F.col("part") / 10) == r["half"])
        for name, p in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
            assert abs(own.where(F.col("v") <= r[name]).count() / r["n"] - p) <= S.RANK_ERROR
