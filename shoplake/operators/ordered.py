"""Ordered scans that stay balanced whatever share of the rows a key owns.

There is one plan for all sizes. Rows are range-partitioned by key, order and a hash of
the row, so a heavy key, null keys, ties and a table without key columns all spread over
the partitions. The partition number is kept as a segment, and the result is stored in
the shared scratch folder: later steps, and tasks run again, see the same segments.
Windows then run per (key, segment).

Only the first and last key of a segment can go on in another one. A summary of these
rows, at most a few per segment, carries state over the cuts. Results are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplake.session import scratch_dir

SEGMENT = "_segment"


def in_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """`df` stored in range partitions of (keys, order), numbered in `_segment`.

    `pieces` sets their number; by default it is the session's, fewer for little data.
    """
    by = [*[F.col(c) for c in [*keys, *order]], row_hash(df)]
    ranged = df.repartitionByRange(pieces, *by) if pieces else df.repartitionByRange(*by)
    placed = ranged.withColumn(SEGMENT, F.spark_partition_id())
    path = scratch_dir(df.sparkSession, "ordered")
    placed.write.parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, but for maps, which have none."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not _has_map(f.dataType)])


def _has_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString()


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
                 previous: Mapping[str, str] | None = None,
                 following: Mapping[str, str] | None = None,
                 running: Mapping[str, str] | None = None,
                 peak_before: Mapping[str, str] | None = None,
                 filled: Mapping[str, str] | None = None,
                 number: str | None = None,
                 pieces: int | None = None,
                 keep_segment: bool = False, presplit: bool = False) -> DataFrame:
    """Add order-dependent columns per key, ascending by `order` (nulls first).

    Each mapping is {new column: source column}:
    `previous` / `following` value of the neighbouring row; `running` sum up to and
    including the row; `peak_before` maximum over earlier rows; `filled` last
    non-null value up to and including the row; `number` is a 1-based position.
    `order` should be unique within a key. A chain of scans with the same keys and
    order is split once: the first keeps its segments, later ones are `presplit`.
    """
    keys, order = list(keys), list(order)
    previous, following = dict(previous or {}), dict(following or {})
    running, peak_before, filled = dict(running or {}), dict(peak_before or {}), dict(filled or {})
    base = df if presplit else in_segments(df, keys, order, pieces)
    types = dict(df.dtypes)

    w = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*[F.col(c) for c in order])

    local: list[Column] = []
    carry: list[Column] = []       # per (key, segment)
    shift: list[Column] = []       # carried to the next segment of the key
    final: dict[str, Column] = {}
    by_segment = Window.partitionBy(*keys).orderBy(SEGMENT)
    earlier = by_segment.rowsBetween(Window.unboundedPreceding, -1)

    def over_cuts(name: str) -> Column:
        return F.coalesce(F.col(name), F.col(f"{name}_carry"))

    def neighbours(side: Mapping[str, str], tag: str, step, pick, jump) -> None:
        if not side:
            return
        row = F.struct(*[F.col(src).alias(out) for out, src in side.items()])
        local.append(step(row).over(w).alias(f"_{tag}"))
        carry.append(pick(row, at).alias(f"_{tag}_edge"))
        shift.append(jump(f"_{tag}_edge").over(by_segment).alias(f"_{tag}_carry"))
        for out in side:
            final[out] = over_cuts(f"_{tag}")[out]

    neighbours(previous, "prev", F.lag, F.max_by, F.lag)
    neighbours(following, "next", F.lead, F.min_by, F.lead)
    for out, src in running.items():
        kind = types[src]
        wide = kind if kind.startswith("decimal") or kind == "double" else "bigint"
        local.append(F.sum(src).over(upto).alias(f"_run_{out}"))
        carry.append(F.sum(src).alias(f"_run_{out}_edge"))
        shift.append(F.sum(f"_run_{out}_edge").over(earlier).alias(f"_run_{out}_carry"))
        zero = F.lit(0).cast("bigint" if wide == "bigint" else wide)
        final[out] = F.coalesce(F.col(f"_run_{out}"), zero) + F.coalesce(F.col(f"_run_{out}_carry"), zero)
    for out, src in peak_before.items():
        local.append(F.max(src).over(before).alias(f"_peak_{out}"))
        carry.append(F.max(src).alias(f"_peak_{out}_edge"))
        shift.append(F.max(f"_peak_{out}_edge").over(earlier).alias(f"_peak_{out}_carry"))
        final[out] = F.greatest(F.col(f"_peak_{out}"), F.col(f"_peak_{out}_carry"))
    for out, src in filled.items():
        local.append(F.last(src, ignorenulls=True).over(upto).alias(f"_fill_{out}"))
        carry.append(F.max_by(F.col(src), F.when(F.col(src).isNotNull(), at)).alias(f"_fill_{out}_edge"))
        shift.append(F.last(f"_fill_{out}_edge", ignorenulls=True).over(earlier).alias(f"_fill_{out}_carry"))
        final[out] = over_cuts(f"_fill_{out}")
    if number:
        local.append(F.row_number().over(w).cast("bigint").alias("_nr"))
        carry.append(F.count(F.lit(1)).alias("_nr_edge"))
        shift.append(F.sum("_nr_edge").over(earlier).alias("_nr_carry"))
        final[number] = F.col("_nr") + F.coalesce(F.col("_nr_carry"), F.lit(0))

    scanned = base.select("*", *local)
    kept = [F.col(c) for c in df.columns if c not in final and c != SEGMENT]
    if keep_segment:
        kept.append(F.col(SEGMENT))
    result = [*kept, *[expr.alias(out) for out, expr in final.items()]]
    edges = (_end_rows(base, keys).groupBy(*keys, SEGMENT).agg(*carry)
             .select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col(SEGMENT).alias("_at_segment"), *shift))
    same = F.col(SEGMENT) == F.col("_at_segment")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    # at most two keys per segment, so the summary is bounded by the number of partitions
    return scanned.join(F.broadcast(edges), same, "left").select(*result)


def _end_rows(base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the keys that are first or last in some segment; all rows where there are no keys."""
    if not keys:
        return base
    key = F.struct(*[F.col(k).alias(f"_end{i}") for i, k in enumerate(keys)])
    ends = (base.groupBy(SEGMENT).agg(F.array(F.min(key), F.max(key)).alias("_ends"))
            .select(F.explode("_ends").alias("_end")).select("_end.*").distinct())
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_end{i}"))
    return base.join(F.broadcast(ends), same, "left_semi")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float],
                    pieces: int | None = None) -> DataFrame:
    """Exact interpolated quantiles per group, one column per entry of `probs`.

    Rows collapse to distinct values map-side; the positions are then found from
    running counts, so no group is gathered in one place.
    """
    by = list(by)
    counts = (df.where(F.col(value).isNotNull()).groupBy(*by, value)
              .agg(F.count(F.lit(1)).alias("_n")))
    ranked = ordered_scan(counts, by, [value], running={"_upto": "_n"}, pieces=pieces)
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    placed = ranked.join(totals, by) if by else ranked.withColumn("_total", totals.scalar())
    bounds = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = F.when(F.col("_upto") > place, F.col(value).cast("double"))
            bounds.append(F.min(hit).alias(f"_{name}_{side}"))
    picked = placed.groupBy(*by).agg(F.max("_total").alias("_total"), *bounds)
    columns = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        columns.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*by, *columns)
