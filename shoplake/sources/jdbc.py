"""JDBC tables, read in parallel by key range and written in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_options(url: str, table: str, key: str, lower: int, upper: int, partitions: int,
                 fetch: int = 10_000, **extra: str) -> dict[str, str]:
    """Options of a key-range scan: `partitions` queries, one range of the key each."""
    return {"url": url, "dbtable": table, "partitionColumn": key, "lowerBound": str(lower),
            "upperBound": str(upper), "numPartitions": str(partitions), "fetchsize": str(fetch),
            "pushDownPredicate": "true", **extra}


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int],
              partitions: int, **extra: str) -> DataFrame:
    return spark.read.format("jdbc").options(
        **read_options(url, table, key, bounds[0], bounds[1], partitions, **extra)).load()


def write_options(url: str, table: str, batch: int = 1000, **extra: str) -> dict[str, str]:
    """Options of a batched append; `rewriteBatchedStatements` makes multi-row inserts."""
    return {"url": url, "dbtable": table, "batchsize": str(batch),
            "rewriteBatchedStatements": "true", "isolationLevel": "READ_COMMITTED", **extra}


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 1000, **extra: str) -> None:
    df.write.format("jdbc").options(**write_options(url, table, batch, **extra)).mode("append").save()
