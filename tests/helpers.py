"""Small frames for fixtures."""

from pyspark.sql import functions as F

LOG = "change_id long, product_id long, new_price string, change_type string, change_time string"


def price_log(spark, rows):
    """Rows (change_id, product_id, new_price, change_type, change_time) as a typed log."""
    return spark.createDataFrame(rows, LOG).select(
        "change_id", "product_id", F.lit(None).cast("decimal(10,2)").alias("old_price"),
        F.col("new_price").cast("decimal(10,2)").alias("new_price"), "change_type",
        F.col("change_time").cast("timestamp_ntz").alias("change_time"))


def products(spark, rows):
    """Rows (product_id, price, stock, status)."""
    return spark.createDataFrame(rows, "product_id long, price string, stock int, status int").select(
        "product_id", F.col("price").cast("decimal(10,2)").alias("price"), "stock",
        F.col("status").cast("tinyint").alias("status"), F.lit(0).cast("tinyint").alias("is_deleted"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("update_time"))


def typed(df, *columns, kind="timestamp_ntz"):
    return df.withColumns({c: F.col(c).cast(kind) for c in columns})


def rows(df, *columns):
    """Sorted tuples, times and decimals as text."""
    picked = df.select(*columns) if columns else df
    out = []
    for r in picked.collect():
        out.append(tuple(str(v) if not isinstance(v, int | float | str | type(None)) else v for v in r))
    return sorted(out, key=repr)
