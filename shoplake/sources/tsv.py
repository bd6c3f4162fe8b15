"""Tab-separated files: `\\N` is NULL, an empty field is an empty string."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplake.functions.textfields import escape_field, unescape_field


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Typed rows of one or more files or folders. Tabs never occur inside a field."""
    parts = spark.read.option("lineSep", "\n").text(path).select(F.split("value", "\t", -1).alias("_f"))
    return parts.select(*[unescape_field(F.get("_f", F.lit(i))).cast(f.dataType).alias(f.name)
                          for i, f in enumerate(schema.fields)])


SHARD_ROWS = 1_000_000


def shard_count(rows: int, shards: int) -> int:
    """The least multiple of `shards` whose files hold at most `SHARD_ROWS` rows: each is one task's work."""
    return shards * max(1, -(-rows // (shards * SHARD_ROWS)))


def write_tsv(df: DataFrame, path: str, shards: int | None = None, mode: str = "overwrite") -> None:
    """One text file per partition, or `shards` files of equal size, several times as many for many rows."""
    line = F.concat_ws("\t", *[escape_field(F.col(c)) for c in df.columns]).alias("value")
    lines = df.select(line)
    if shards:
        lines = lines.repartition(shard_count(df.count(), shards))
    lines.write.mode(mode).option("lineSep", "\n").text(path)
