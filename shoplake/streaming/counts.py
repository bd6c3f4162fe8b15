"""Row counts of streams over any run length."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class RowCounts(StreamingQueryListener):
    """Counts of observed rows, one per query and batch: a repeated batch replaces its count.

    Spark keeps the latest progress reports only; a listener gets all of them.
    """

    def __init__(self, name: str):
        self.name = name
        self.batches: dict[tuple[str, int], int] = {}

    def observe(self, stream: DataFrame) -> DataFrame:
        return stream.observe(self.name, F.count(F.lit(1)).alias("rows"))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = row["rows"]

    def onQueryTerminated(self, event) -> None:
        pass

    def total(self, query: StreamingQuery, patience: float = 60) -> int:
        """Rows of a query that has ended; waits for the report of its last batch."""
        last = query.lastProgress
        end = time.monotonic() + patience
        while last is not None and (str(query.id), last["batchId"]) not in self.batches:
            if time.monotonic() > end:
                raise TimeoutError(f"no report of batch {last['batchId']} of query {query.id}")
            time.sleep(0.05)
        return sum(n for (id_, _), n in self.batches.items() if id_ == str(query.id))

    def save(self, spark: SparkSession, path: str) -> None:
        """Counts per batch as a table (query_id, batch_id, rows)."""
        rows = [(q, b, n) for (q, b), n in sorted(self.batches.items())]
        spark.createDataFrame(rows, "query_id string, batch_id long, rows long").write.mode("overwrite").parquet(path)


@contextmanager
def row_counts(spark: SparkSession, name: str) -> Iterator[RowCounts]:
    """A listener that counts the rows of streams passed through its `observe`."""
    counts = RowCounts(name)
    spark.streams.addListener(counts)
    try:
        yield counts
    finally:
        spark.streams.removeListener(counts)
