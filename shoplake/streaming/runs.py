"""Starting streams: over everything available now, or continuously."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from shoplake.operators.ordered import SEGMENT, row_hash
from shoplake.sources.batches import run_id

SAMPLED = 200_000           # keys that tell about where chunks part; so many rows or fewer are sorted outright


def run(writer: DataStreamWriter, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start a writer. Without an interval, work through all input and stop."""
    writer = writer.option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int, str], None], checkpoint: str,
               every: str | None = None, hold: bool = True) -> StreamingQuery:
    """foreachBatch with the batch read once. Handlers get the batch, its number and the run
    that numbers it, and must be idempotent per run and number. A handler that itself reads the
    batch once needs no `hold` of its rows."""
    def guarded(batch: DataFrame, batch_id: int) -> None:
        if not hold:
            handle(batch, batch_id, run_id(batch.sparkSession, checkpoint))
            return
        held = batch.persist()
        try:
            handle(held, batch_id, run_id(batch.sparkSession, checkpoint))
        finally:
            held.unpersist()

    return run(stream.writeStream.outputMode("update").foreachBatch(guarded), checkpoint, every)


def append_sink(stream: DataFrame, path: str, checkpoint: str, every: str | None = None,
                partition_by: list[str] | None = None) -> StreamingQuery:
    """Append-only table from a stream."""
    writer = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return run(writer, checkpoint, every)


def stage_in_order(df: DataFrame, path: str, order: list[str], chunk: int, files: int = 2,
                   pieces: int | None = None) -> int:
    """Write rows as `files` files per `chunk` rows in `order`, oldest chunk first.

    A file stream takes files by modification time, so reading the folder with `files`
    files per trigger replays the order, a chunk at a time. Chunks are written by one job
    each; a store whose clock is too coarse to keep them apart is an error.

    Only the order columns and a hash of the row are sorted, and of many rows only those about
    the places where chunks part. The rows themselves are not shuffled: a chunk is a pass over `df`, which
    must give the same rows each time, and a file what one task found, in no order. Empty
    files fill up a chunk. Needs `files` <= `chunk`.
    """
    if not 1 <= files <= chunk:
        raise ValueError(f"cannot write {files} files per chunk of {chunk} rows")
    spark = df.sparkSession
    total, cuts = _cuts(df, order, f"{path}/_cuts", chunk, pieces)
    stored = spark.read.parquet(f"{path}/_cuts/found") if cuts else None

    def beside(at: int, back: bool, equal: bool = False) -> Column:
        return _beside(df, order, stored, at, back, equal)

    count = -(-total // chunk)
    newest = -1
    for i in range(count):
        start, end = i * chunk, (i + 1) * chunk
        inside = F.lit(True)
        if start:
            inside &= beside(start, back=False) if cuts[start][1] > 1 else ~beside(start, back=True)
        if end < total:
            inside &= beside(end, back=True)
        part = df.where(inside)
        # rows that are equal throughout may lie on both sides of a cut: each side gets its number of copies
        equal = {cuts[at][0]: (at, cuts[at][1]) for at in (start, end) if at in cuts and cuts[at][1] > 1}
        for first, (at, copies) in equal.items():
            share = min(end, first + copies) - max(start, first)
            if share > 0:
                one = df.where(beside(at, back=False, equal=True)).limit(1).withColumn("_one", F.lit(1))
                part = part.unionByName(spark.range(share).select(F.lit(1).alias("_one")).join(F.broadcast(one), "_one").drop("_one"))
        part.coalesce(files).write.option("compression", "zstd").parquet(f"{path}/feed/chunk={i}")
        _fill_up(spark, df.schema, f"{path}/feed/chunk={i}", files, f"{path}/_cuts/empty")
        times = _file_times(spark, f"{path}/feed/chunk={i}")
        if min(times) <= newest:
            raise RuntimeError("files of two chunks have one modification time: their order would be lost")
        newest = max(times)
    return count


def _beside(df: DataFrame, order: list[str], stored: DataFrame, at: int, back: bool, equal: bool = False) -> Column:
    """Whether a row lies before (`back`) or after the one `stored` for a place, or is `equal` to it; few rows need their hash."""
    here = F.struct(*order)
    edge = stored.where(F.col("_place") == at).select(F.struct(*[F.col(f"_edge.`{c}`") for c in order])).scalar()
    tie, at_edge = row_hash(df), stored.where(F.col("_place") == at).select("_edge._tie").scalar()
    same = (tie == at_edge) if equal else (tie < at_edge) if back else (tie > at_edge)
    return F.when(here < edge, back and not equal).when(here > edge, not back and not equal).otherwise(same)


def _keys(df: DataFrame, order: list[str]) -> DataFrame:
    return df.select(F.struct(*order, row_hash(df).alias("_tie")).alias("_key")).select("_key.*")


def _cuts(df: DataFrame, order: list[str], path: str, chunk: int, pieces: int | None) -> tuple[int, dict[int, tuple[int, int]]]:
    """The number of rows and, for each multiple of `chunk` below it, where the rows equal to the one at this
    place begin and how many they are. Their keys are stored as (_place, _edge) in `found` under `path`.

    Each sorted partition is one file, so a row's place is its number in the file after the rows of the files before
    and after the rows that were left out before it.
    """
    spark = df.sparkSession
    total = df.count()
    places = range(chunk, total, chunk)
    if not places and total > SAMPLED:
        return total, {}
    keys, skipped = _near(df, order, path, places, total) or (_keys(df, order), dict.fromkeys(places, 0))
    ranged = keys.repartitionByRange(pieces, *keys.columns) if pieces else keys.repartitionByRange(*keys.columns)
    placed = ranged.sortWithinPartitions(*keys.columns).withColumn(SEGMENT, F.spark_partition_id())
    placed.write.option("maxRecordsPerFile", 0).option("compression", "zstd").parquet(f"{path}/keys")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/keys").select("*", F.col("_metadata.row_index").alias("_row"))
    before, offsets = 0, []
    for segment, size in sorted(tuple(r) for r in stored.groupBy(SEGMENT).count().collect()):
        offsets.append((segment, before, size))
        before += size
    wanted = [(s, at - skipped[at] - start, at) for at in places for s, start, size in offsets
              if start <= at - skipped[at] < start + size]
    if not wanted:
        return total, {}
    here = spark.createDataFrame(wanted, f"{SEGMENT} int, _row long, _place long")
    edge = F.struct(*keys.columns).alias("_edge")
    stored.join(F.broadcast(here), [SEGMENT, "_row"]).select("_place", edge).write.parquet(f"{path}/found")
    found = spark.read.parquet(f"{path}/found")
    starts = spark.createDataFrame([o[:2] for o in offsets], f"{SEGMENT} int, _before long")
    same = [F.col(f"k.`{c}`").eqNullSafe(F.col(f"f._edge.`{c}`")) for c in keys.columns]
    equal = (stored.join(F.broadcast(starts), SEGMENT).alias("k").join(F.broadcast(found).alias("f"), reduce(Column.__and__, same))
             .groupBy("_place").agg(F.min(F.col("_before") + F.col("_row")).alias("first"), F.count(F.lit(1)).alias("copies")))
    return total, {r["_place"]: (r["first"] + skipped[r["_place"]], r["copies"]) for r in equal.collect()}


def _near(df: DataFrame, order: list[str], path: str, places: range, total: int) -> tuple[DataFrame, dict[int, int]] | None:
    """Keys of the rows about `places` and, for each place, how many rows before it are left out; none where that saves little.

    A sample says between which keys a place must lie, six deviations of its rank to each side. One pass counts
    the rows before, in and after each such stretch and keeps those in it. All copies of a key are in the same
    stretch. The counts prove that a place is in its stretch; if one is not, all keys are to be sorted.
    """
    spark = df.sparkSession
    if total <= SAMPLED:
        return None
    _keys(df.sample(SAMPLED / total, seed=1), order).repartition(1).sortWithinPartitions(*order, "_tie") \
        .write.option("maxRecordsPerFile", 0).parquet(f"{path}/sample")
    sample = spark.read.parquet(f"{path}/sample")
    size = sample.count()
    reach = 3 * ceil(sqrt(size)) + 1
    stretches: list[list[int]] = []
    for at in places:
        rank = at * size // total
        if stretches and rank - reach <= stretches[-1][1]:
            stretches[-1][1] = rank + reach
        else:
            stretches.append([rank - reach, rank + reach])
    if stretches[0][0] < 0 or stretches[-1][1] >= size or 2 * sum(b - a for a, b in stretches) > size:
        return None
    ranks = spark.createDataFrame([(r, i) for i, r in enumerate(r for s in stretches for r in s)], "_row long, _place long")
    edge = F.struct(*[F.col(c) for c in sample.columns]).alias("_edge")
    sample.select("*", F.col("_metadata.row_index").alias("_row")).join(F.broadcast(ranks), "_row") \
        .select("_place", edge).write.parquet(f"{path}/ends")
    stored = spark.read.parquet(f"{path}/ends")
    held = {r["_place"]: r["_edge"] for r in stored.collect()}
    ends = [(2 * i, 2 * i + 1) for i in range(len(stretches))]
    for i in range(len(ends) - 1, 0, -1):       # one key ends a stretch and begins the next: they are one
        if held[ends[i - 1][1]] == held[ends[i][0]]:
            ends[i - 1:i + 1] = [(ends[i - 1][0], ends[i][1])]
    # even: before the stretch of half this number or after the one before it; odd: in a stretch, its ends included
    zone = sum((F.when(_beside(df, order, stored, first, back=True), 0).otherwise(1)
                + F.when(_beside(df, order, stored, last, back=False), 1).otherwise(0) for first, last in ends), F.lit(0))
    seen = Observation()
    zones = range(2 * len(ends) + 1)
    counted = df.withColumn("_zone", zone).observe(seen, *[F.count_if(F.col("_zone") == z).alias(f"z{z}") for z in zones])
    near = counted.where(F.col("_zone") % 2 == 1).select(F.struct(*order, row_hash(df).alias("_tie")).alias("_key"))
    near.select("_key.*").write.option("compression", "zstd").parquet(f"{path}/near")
    rows = [seen.get[f"z{z}"] for z in zones]
    skipped = {}
    for at in places:
        inside = [z for z in zones if z % 2 and sum(rows[:z]) <= at < sum(rows[:z + 1])]
        if not inside:
            return None
        skipped[at] = sum(rows[:inside[0]:2])
    return spark.read.parquet(f"{path}/near"), skipped


def _fill_up(spark: SparkSession, schema: T.StructType, path: str, files: int, empty: str) -> None:
    """Copies of an empty file, stored in `empty`, until `path` has `files` data files."""
    missing = files - len(_file_times(spark, path))
    if missing <= 0:
        return
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    spark.createDataFrame([], schema).write.mode("ignore").parquet(empty)
    fs = hadoop.Path(empty).getFileSystem(conf)
    source = next(e.getPath() for e in fs.listStatus(hadoop.Path(empty)) if e.getPath().getName().endswith(".parquet"))
    for i in range(missing):
        hadoop.FileUtil.copy(fs, source, fs, hadoop.Path(f"{path}/part-empty-{i}.parquet"), False, True, conf)


def _file_times(spark: SparkSession, path: str) -> list[int]:
    """Modification times of the data files below `path`."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    times = []
    while found.hasNext():
        entry = found.next()
        if entry.getPath().getName().endswith(".parquet"):
            times.append(entry.getModificationTime())
    return times


def replay_stream(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 2) -> DataFrame:
    """Stream over a folder written by `stage_in_order`, with as many files per trigger as a chunk has."""
    return (spark.readStream.schema(T.StructType([*schema.fields, T.StructField("chunk", T.IntegerType())]))
            .option("maxFilesPerTrigger", per_trigger).parquet(f"{path}/feed").select(*schema.names))
