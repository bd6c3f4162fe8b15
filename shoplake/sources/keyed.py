"""A keyed table kept as a snapshot plus batches of changes.

Each batch is a folder named by its run and number, so writing one again replaces it and
a re-run of a micro-batch changes nothing, while a new run, which numbers from 0 again,
overwrites nothing. Reads replay the batches over the latest finished snapshot by source
order, so late and repeated events cannot win over newer ones. `compact` folds the
batches into a new snapshot beside the old one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplake.operators.changes import latest_per_key
from shoplake.sources import batches as log
from shoplake.sources.batches import BatchKey
from shoplake.sources.lake import folders

BY_HAND = "direct"              # run of batches that no stream wrote


@dataclass(frozen=True)
class KeyedTable:
    path: str
    schema: T.StructType        # table columns, `op` and the sequence columns
    keys: list[str]
    seq: list[str]
    partition: tuple[str, ...] = ()     # of the keys: folders that a filter on them skips

    @property
    def changes(self) -> str:
        return f"{self.path}/changes"

    def append(self, batch: DataFrame, batch_id: int, run: str = BY_HAND) -> None:
        """Store a batch, reduced to its latest row per key; deletes stay as tombstones.

        A batch that a snapshot has folded already can only be the same batch again. If it
        was never stored, its number has gone backwards within a run, and reads would miss it: an error.
        """
        spark = batch.sparkSession
        covered = self._snapshots(spark)
        key = log.label(spark, self.changes, run), batch_id
        if covered and key <= covered[-1] and key not in self.batches(spark):
            raise ValueError(f"batch {key} is older than the snapshot up to {covered[-1]}; number batches onwards")
        latest = latest_per_key(batch.select(*self.schema.names), self.keys, self.seq, keep_deletes=True)
        log.write_batch(latest, self.changes, run, batch_id, self.partition)

    def _read(self, spark: SparkSession, base: str, paths: list[str], places: list[T.StructField]) -> DataFrame:
        """Folders below `base`; their numbers are left out."""
        return spark.read.option("basePath", base).schema(T.StructType([*self.schema.fields, *places])) \
            .parquet(*paths).select(*self.schema.names)

    def _snapshots(self, spark: SparkSession) -> list[BatchKey]:
        """The last batch of each finished snapshot."""
        names = [n.split("=", 1)[1] for n in folders(spark, f"{self.path}/snapshot", done=True)]
        return sorted((n.rsplit("~", 1)[0], int(n.rsplit("~", 1)[1])) for n in names)

    def rows(self, spark: SparkSession, before: BatchKey | None = None) -> DataFrame:
        """Latest snapshot and the batches after it, tombstones included."""
        covered = None
        parts = []
        snapshots = [n for n in self._snapshots(spark) if before is None or n < before]
        if snapshots:
            covered = snapshots[-1]
            parts.append(self._read(spark, f"{self.path}/snapshot", [self._snapshot(covered)],
                                    [T.StructField("upto", T.StringType())]))
        paths = [log.folder(self.changes, n) for n in self.batches(spark)
                 if (covered is None or n > covered) and (before is None or n < before)]
        if paths:
            parts.append(self._read(spark, self.changes, paths, log.PLACES))
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], self.schema)

    def _snapshot(self, upto: BatchKey) -> str:
        return f"{self.path}/snapshot/upto={upto[0]}~{upto[1]}"

    def current(self, spark: SparkSession, before: BatchKey | None = None,
                keep_deletes: bool = False) -> DataFrame:
        """One row per live key. `before` leaves out that batch and later ones."""
        return latest_per_key(self.rows(spark, before), self.keys, self.seq, keep_deletes=keep_deletes)

    def batches(self, spark: SparkSession) -> list[BatchKey]:
        """Keys of the batches stored so far, in order."""
        return log.finished(spark, self.changes)

    def compact(self, spark: SparkSession) -> BatchKey | None:
        """Fold all batches into a snapshot. Tombstones stay: a late event may follow."""
        found = self.batches(spark)
        if not found:
            return None
        if found[-1] not in self._snapshots(spark):
            folded = self.current(spark, before=(found[-1][0], found[-1][1] + 1), keep_deletes=True)
            if self.partition:
                folded = folded.hint("rebalance", *[F.col(c) for c in self.partition])
            folded.write.mode("overwrite").partitionBy(*self.partition).parquet(self._snapshot(found[-1]))
        return found[-1]
