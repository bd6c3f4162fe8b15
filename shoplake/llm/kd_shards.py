"""K-d tree sharding: split at distributed weighted medians along the widest dimension.

A row is a point of metadata dimensions with a weight in bytes. A node is cut along
the dimension of widest spread at its weighted median, until leaves reach the target.
Each dimension is read as a whole number, with a hash of the row's group appended, so
rows of equal value can part while equal groups never do.

The median is found by refining a histogram: byte sums per node and slice of the value
range are aggregated map-side, the slice holding the median is cut again, until one
value is left. The driver sees one row per node and round, whatever the number of rows;
nodes meet their rows by a join with a table of one row per node, so plans do not grow
with the leaves. Rows are never sorted or gathered for it. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplake.llm.shared import stored

SLICE_BITS = 12
SLICES = 1 << SLICE_BITS
HASH_BITS = 24                  # of the group's hash, below the dimension's value
VALUE_BITS = 36                 # of the dimension's value; larger ones count as the largest


@dataclass
class Split:
    """Rows of `node` whose position in dimension `dim` is at most `cut` go to child 2n+1, others to 2n+2."""
    node: int
    dim: int
    cut: int


def _position(dim: str, group: str) -> Column:
    value = F.least(F.greatest(F.coalesce(F.col(dim).cast("long"), F.lit(0)), F.lit(0)), F.lit((1 << VALUE_BITS) - 1))
    return F.shiftleft(value, HASH_BITS).bitwiseOR(
        F.pmod(F.xxhash64(F.lit(dim), F.col(group)), F.lit(1 << HASH_BITS)))


def _along(inner: Sequence[str]) -> Column:
    """Position in the dimension that the row's node is cut in."""
    return F.element_at(F.array(*inner), F.col("dim") + 1)


def _medians(points: DataFrame, inner: Sequence[str], wanted: dict[int, tuple[int, int]]) -> list[Split]:
    """For each node its cut: the least position up to which at least the wanted weight lies."""
    spark = points.sparkSession
    left = {node: (dim, 0, need) for node, (dim, need) in wanted.items()}
    bits = VALUE_BITS + HASH_BITS
    by_slice = Window.partitionBy("node").orderBy("slice")          # SLICES rows at most
    while bits > 0:
        step = min(SLICE_BITS, bits)
        bits -= step
        state = spark.createDataFrame([(n, *x) for n, x in left.items()], "node long, dim int, low long, need long")
        at = _along(inner)
        sums = (points.join(F.broadcast(state), "node").where(F.shiftrightunsigned(at, bits + step) == F.col("low"))
                .groupBy("node", "need", F.shiftrightunsigned(at, bits).alias("slice")).agg(F.sum("weight").alias("weight")))
        upto = F.sum("weight").over(by_slice)
        held = sums.select("node", "slice", (F.col("need") - upto + F.col("weight")).alias("rest"),
                           ((upto >= F.col("need")) | F.lead("slice").over(by_slice).isNull()).alias("enough"))
        found = held.where("enough").groupBy("node").agg(F.min_by(F.struct("slice", "rest"), "slice").alias("hit")).collect()
        left = {r["node"]: (left[r["node"]][0], r["hit"]["slice"], r["hit"]["rest"]) for r in found}
    return [Split(node, dim, cut) for node, (dim, cut, _) in left.items()]


def _place(points: DataFrame, inner: Sequence[str], splits: list[Split]) -> DataFrame:
    """Rows of the nodes in `splits` (one level of the tree, one row each) go to their children."""
    table = points.sparkSession.createDataFrame([(s.node, s.dim, s.cut) for s in splits], "node long, dim int, cut long")
    child = 2 * F.col("node") + F.when(_along(inner) <= F.col("cut"), 1).otherwise(2)
    return points.join(F.broadcast(table), "node", "left") \
        .withColumn("node", F.when(F.col("dim").isNull(), F.col("node")).otherwise(child)).drop("dim", "cut")


def kd_shards(rows: DataFrame, dims: Sequence[str], weight: str, group: str, *,
              leaves: int | None = None, target: int | None = None) -> DataFrame:
    """`rows` plus `shard` 0.., for `leaves` shards or for shards of about `target` weight.

    `dims` are whole-number columns and must not differ within a `group`. Their spread is
    compared on a log scale, from the lowest to the highest value of the node. A null
    dimension counts as 0, a null weight as none; an empty table stays empty; rows that
    tie in everything stay together. Other columns of `rows` may have any name but `shard`. A node that holds one group only is not cut, its
    other shards stay empty. Shard sizes differ by the weight of one group at a cut.
    """
    inner = [f"_d{i}" for i in range(len(dims))]
    points = stored(rows.select(*[_position(d, group).alias(i) for d, i in zip(dims, inner, strict=True)],
                                F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("weight"))
                    .groupBy(*inner).agg(F.sum("weight").alias("weight")), "kd-points")
    if leaves is None:
        total = points.agg(F.sum("weight")).first()[0] or 0
        leaves = max(1, -(-total // max(1, target)))
    parts, splits = {0: leaves}, []
    points = points.withColumn("node", F.lit(0).cast("long"))
    while any(n > 1 for n in parts.values()):
        spread = points.groupBy("node").agg(
            F.sum("weight").alias("weight"),
            *[F.min(i).alias(f"min{i}") for i in inner], *[F.max(i).alias(f"max{i}") for i in inner]).collect()
        wanted, following = {}, {}
        for r in spread:
            node = r["node"]
            if parts.get(node, 1) < 2:
                continue
            wide = [((r[f"max{i}"] >> HASH_BITS) + 1) / ((r[f"min{i}"] >> HASH_BITS) + 1) for i in inner]
            dim = max(range(len(inner)), key=lambda d: (wide[d], r[f"max{inner[d]}"] - r[f"min{inner[d]}"]))
            first = parts[node] // 2
            if r[f"max{inner[dim]}"] > r[f"min{inner[dim]}"]:
                wanted[node] = (dim, -(-r["weight"] * first // parts[node]))
                following |= {2 * node + 1: first, 2 * node + 2: parts[node] - first}
        if wanted:
            splits.append(_medians(points, inner, wanted))
            points = stored(_place(points, inner, splits[-1]), "kd-points")
        parts = {n: k for n, k in parts.items() if n not in wanted and k < 2} | following
    named = {c: f"_row{i}" for i, c in enumerate(rows.columns)}         # the caller's columns may have any name
    placed = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()],
                         *[_position(d, group).alias(i) for d, i in zip(dims, inner, strict=True)], F.lit(0).cast("long").alias("node"))
    for level in splits:
        placed = _place(placed, inner, level)
    cut = {s.node for level in splits for s in level}
    ends = sorted(c for n in cut for c in (2 * n + 1, 2 * n + 2) if c not in cut) or [0]
    shards = rows.sparkSession.createDataFrame(list(zip(ends, range(len(ends)), strict=True)), "node long, shard int")
    return placed.join(F.broadcast(shards), "node").select(*[F.col(n).alias(c) for c, n in named.items()], "shard")


def numbered(rows: DataFrame, part: str, order: Sequence[str], number: str = "slot") -> DataFrame:
    """Add the 0-based position of each row within `part`, by `order`, without a window over a part.

    Rows are range-partitioned and sorted once; a partition's rows are numbered in
    passing, and the counts of earlier partitions, one row per (partition, part), are added.
    """
    ordered = stored(rows.repartitionByRange(F.col(part), *[F.col(c) for c in order])
                     .sortWithinPartitions(part, *order)
                     .withColumn("_at", F.monotonically_increasing_id()), "numbered")
    here = F.shiftright("_at", 33).alias("_piece")
    counts = ordered.groupBy(part, here).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    earlier = Window.partitionBy(part).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, "_piece", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_from"))
                           .alias("_shift"))
    return (ordered.withColumn("_piece", here).join(starts, [part, "_piece"])
            .withColumn(number, F.col("_at") + F.col("_shift")).drop("_at", "_piece", "_shift"))


def shard_documents(docs: DataFrame, leaves: int) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): equal texts share a shard, sizes are near equal.

    Size is the text's UTF-8 bytes (null: none) plus 1. Dimensions: size, characters
    beyond ASCII, lines, and words, all of the text, so that equal texts agree in them.
    A text that outweighs a shard fills one by itself.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    n_bytes = F.octet_length(text).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (n_bytes + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text, F.col("text").isNull()).alias("_group"), (n_bytes - F.char_length(text)).alias("_wide"),
        (F.char_length(text) - F.char_length(F.translate(text, "\n", ""))).alias("_lines"),
        (F.char_length(text) - F.char_length(F.translate(text, " ", ""))).alias("_words"))
    dims = ["size", "_wide", "_lines", "_words"]
    placed = kd_shards(stored(rows, "kd-rows"), dims, "size", "_group", leaves=leaves)
    return numbered(placed.select("doc_id", "size", "text_crc32", "shard"), "shard",
                    ["doc_id", "text_crc32", "size"])
