"""Parquet tables of the lake: reloads, date partitions, buckets, appends, mirrors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Reload a table; running it again gives the same table."""
    df.write.mode(mode).parquet(path)


def by_date(df: DataFrame, ts: str, partition: str, grain: str = "day") -> DataFrame:
    """`df` with its partition's date, dealt out for a write by it.

    The rebalance lets adaptive execution cut a heavy day into several files and
    merge light ones, so no task holds one whole day. By year a task's rows make few
    files as they come, so there they are not shuffled.
    """
    dated = df.withColumn(partition, F.to_date(F.date_trunc(grain, ts)))
    return dated if grain == "year" else dated.hint("rebalance", F.col(partition))


def write_partitioned(df: DataFrame, path: str, ts: str, partition: str = "order_date",
                      sort_by: list[str] | None = None, grain: str = "day") -> None:
    """Write by day (or by `grain`), replacing only the partitions present in `df`.

    Use a wider grain where a day is far below the size of a file.
    """
    dated = by_date(df, ts, partition, grain)
    if sort_by:
        dated = dated.sortWithinPartitions(partition, *sort_by)
    (dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))


def bucket_count(rows: int, per_bucket: int = 2_000_000, least: int = 8) -> int:
    """Buckets for the larger of two tables that are to join by bucket: each is one task's work."""
    return max(least, -(-rows // per_bucket))


def write_bucketed(df: DataFrame, table: str, n: int, key: str, path: str | None = None) -> None:
    """Catalog table in n buckets of `key`; equal layouts join without a shuffle.

    A bucket is written by one task, so choose a key without heavy values. With `path`
    the files lie there and not in the warehouse folder.
    """
    writer = (df.repartition(n, key).write.mode("overwrite").format("parquet")
              .bucketBy(n, key).sortBy(key))
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def folders(spark: SparkSession, path: str, done: bool = False) -> list[str]:
    """Names of the folders in `path`, if `done` only those with a success mark."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    return [e.getPath().getName() for e in fs.listStatus(root) if e.isDirectory()
            and (not done or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(e.getPath(), "_SUCCESS")))]


def read_changelog(spark: SparkSession, path: str, schema: T.StructType, streaming: bool = False,
                   files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """A change table as a static frame or as a stream."""
    reader = (spark.readStream if streaming else spark.read).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if streaming and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def query_in_place(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Serving path A: read the lake table where it lies."""
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def mirror_table(spark: SparkSession, source: str, target: str, checkpoint: str,
                 schema: T.StructType | None = None) -> DataFrame:
    """Serving path B: copy new files of the lake table into a mirror, then read that.

    Only appended tables can be followed. If a file that was copied has gone, the table
    was rewritten and its rows would come twice: an error. Mirror it into a new folder then.
    """
    schema = schema or spark.read.parquet(source).schema
    files = spark.read.schema(schema).parquet(source).select(F.input_file_name().alias("file")).distinct()
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}-files")
    if marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        copied = spark.read.parquet(f"{checkpoint}-files").select("file").distinct()
        if copied.join(files, "file", "left_anti").limit(1).count():
            raise ValueError(f"{source} was rewritten after it was mirrored; mirror it into a new folder")
    query = (spark.readStream.schema(schema).parquet(source).writeStream.format("parquet")
             .option("path", target).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    files.write.mode("append").parquet(f"{checkpoint}-files")
    return spark.read.schema(schema).parquet(target)
