"""Embedding near duplicates through a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. It is filed
in the lists of its first LISTS pivots; two vectors of one list are candidates if they
share at least SHARED of their first PREFIX pivots, and candidates are verified by
their cosine in double precision. A pair that meets in several lists is judged in the
first of them, so links are counted without being written out.

The pivots are a bounded sample, about the square root of the number of vectors, so
lists grow no faster than that. Equal vectors are filed once, with their number. A
list of more than BLOCK vectors is cut into parts that meet pairwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from shoplake.llm.components import components
from shoplake.llm.shared import stored

LEAST_PIVOTS, MOST_PIVOTS = 32, 4096
PREFIX = 12                     # pivots that describe a vector
LISTS = 6                       # of them whose lists hold it
SHARED = 2                      # pivots that candidates have in common
BLOCK = 2048                    # vectors of one list that meet in one block
TILE = 512


def _units(vectors: list[list[float]]) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _fitted(x: np.ndarray, size: int) -> np.ndarray:
    """Cut or filled with zeros to `size` dimensions, for the pivots' sake only."""
    out = np.zeros((len(x), size))
    out[:, :min(size, x.shape[1])] = x[:, :size]
    return out


def pivot_index(vectors: DataFrame) -> DataFrame:
    """(id, n, list, pivot, near array<int>, embedding): each distinct vector in its lists.

    `vectors` has id, n, label and embedding, valid ones only.
    """
    spark = vectors.sparkSession
    count = vectors.count()
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << max(0, count - 1).bit_length() // 2))
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(wanted).select("embedding").collect()
    size = max((len(r[0]) for r in sample), default=1)
    points = np.concatenate([_fitted(_units([r[0]]), size) for r in sample]) if sample else np.zeros((1, size))
    shared = spark.sparkContext.broadcast(points)       # MOST_PIVOTS vectors at most

    def run(batches):
        for batch in batches:
            rows = batch.column("embedding").to_pylist()
            near = [None] * len(rows)
            by_size: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                by_size.setdefault(len(r), []).append(i)
            for at in by_size.values():
                close = _fitted(_units([rows[i] for i in at]), shared.value.shape[1]) @ shared.value.T
                order = np.argsort(-close, axis=1, kind="stable")[:, :PREFIX]
                for i, o in zip(at, order.tolist(), strict=True):
                    near[i] = o
            yield batch.append_column("near", pa.array(near, pa.list_(pa.int32())))
    schema = vectors.select("id", "n", "label", "embedding").schema.add("near", ArrayType(IntegerType()))
    indexed = vectors.select("id", "n", "label", "embedding").mapInArrow(run, schema)
    return indexed.withColumn("pivot", F.explode(F.slice("near", 1, LISTS))).select(
        "id", "n", F.xxhash64("label", F.size("embedding"), "pivot").alias("list"), "pivot", "near", "embedding")


def _member(near: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row per vector, one column per pivot of the block: 1 where it is among the given ones."""
    out = np.zeros((len(near), int(at.max()) + 1), np.float32)
    np.put_along_axis(out, at, 1, axis=1)
    return out


def block_links(pivot: int, side: np.ndarray, near: np.ndarray, x: np.ndarray, n: np.ndarray,
                cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, its set's first row) among the rows of a block, or across its two sides."""
    cross = bool(side.any())
    asked = np.flatnonzero(side == 0)
    held = np.flatnonzero(side == 1) if cross else asked
    _, local = np.unique(near, return_inverse=True)
    local = local.reshape(near.shape)
    prefix = _member(near, local)
    first = local[:, :LISTS]
    earlier = np.zeros_like(prefix)
    np.put_along_axis(earlier, first, (near[:, :LISTS] < pivot).astype(np.float32), axis=1)
    links, label = np.zeros(len(x), np.int64), np.arange(len(x))
    for start in range(0, len(asked), TILE):
        q = asked[start:start + TILE]
        candidate = (prefix[q] @ prefix[held].T >= min(SHARED, near.shape[1])) & (earlier[q] @ earlier[held].T == 0)
        if not cross:
            candidate &= q[:, None] != held
        rows, columns = candidate.any(axis=1), candidate.any(axis=0)
        q, h, candidate = q[rows], held[columns], candidate[rows][:, columns]
        linked = candidate & (x[q] @ x[h].T >= cosine)
        links[q] += linked @ n[h]
        if cross:
            links[h] += n[q] @ linked
        for k in np.flatnonzero(linked.any(axis=1)):
            tied = np.unique(np.r_[label[q[k]], label[h[linked[k]]]])
            if len(tied) > 1:
                label[np.isin(label, tied)] = tied[0]
    return links, label


def _linked(cosine: float):
    """Arrow task: rows sorted by block in; (a, b, 0) links and (a, a, number) counts out."""
    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["block"] != held[0]["block"]:
                    yield from emit(held)
                    held = []
                held.append(row)
        if held:
            yield from emit(held)

    def emit(rows):
        if len(rows) < 2:
            return
        ids, n = np.array([r["id"] for r in rows]), np.array([r["n"] for r in rows])
        links, label = block_links(rows[0]["pivot"], np.array([r["side"] for r in rows]),
                                   np.array([r["near"] for r in rows]), _units([r["embedding"] for r in rows]),
                                   n, cosine)
        some, tied = links > 0, label != np.arange(len(rows))
        yield pa.RecordBatch.from_pydict({
            "a": np.r_[ids[some], ids[tied]], "b": np.r_[ids[some], ids[label[tied]]],
            "links": np.r_[links[some], np.zeros(tied.sum(), np.int64)]})
    return run


def near_vectors(vectors: DataFrame, cosine: float) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of `vectors` (vec_id, embedding, label).

    Vectors link if their labels are equal and not null and their cosine is at least
    `cosine`. Null and empty vectors, zero ones, those with null or non-finite
    components and those of another length than the other link with nothing. Rows of equal label and
    embedding are each other's links. A component is its smallest vec_id; rows that share
    a vec_id share what is found for it. Other columns are ignored; an empty table gives none.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    fine = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
            & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
            & F.exists("embedding", lambda v: v != 0))
    distinct = stored(rows.where(fine).groupBy("label", "embedding")
                      .agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), "distinct-vectors")
    filed = stored(pivot_index(distinct), "pivot-lists")
    parts = stored(filed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                   .select("list", F.ceil(F.col("n") / BLOCK).alias("parts")), "list-sizes")
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    blocks = (filed.join(parts, "list").select("list", "id", "n", "pivot", "near", "embedding", part.alias("part"), other)
              .select(F.xxhash64("list", F.least("part", "other"), F.greatest("part", "other")).alias("block"),
                      F.when(F.col("part") > F.col("other"), 1).otherwise(0).alias("side"),
                      "id", "n", "pivot", "near", "embedding"))
    found = stored(blocks.repartition("block").sortWithinPartitions("block", "side", "id")
                   .mapInArrow(_linked(cosine), "a long, b long, links long"), "vector-links")
    roots = components(found, "vector-components")
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    named = stored(distinct.join(roots, F.col("id") == F.col("node"), "left").join(counts, F.col("id") == F.col("a"), "left")
                   .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                           F.coalesce("component", "id").alias("component_id")), "named-vectors")
    alone = rows.where(~F.coalesce(fine, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    tied = rows.where(fine).join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    return tied.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
