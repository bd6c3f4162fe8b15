"""Filter interaction audit by min-plus removal ranks.

A document is a mask of the filters it fails. Over all orders of the filters, its removal
step is the least position of a failed filter: a min-plus product of masks (0 where failed,
infinite elsewhere) with the positions of the filters in each order, the inverse
permutations. Documents are counted per part and mask before that, so the product has
32 rows whatever the corpus; steps then scatter the counts into removed, redundant and
kept documents of every order and step.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplake.llm.shared import arrow_shape, stored

FILTERS = "ABCDE"
LEAST_WORDS = 200
GAP = "[\\x20\\x09-\\x0D]+"                 # between words
SIGNS = "[#$%&*|]"
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")
WEIGHTS = ("n", "good", "toxic")


def removal_steps(filters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(orders, steps, failed): each order's filters; for each mask and order the step, from 0, that removes its
    documents, `filters` where none does; for each mask which filters it fails."""
    orders = np.array(list(permutations(range(filters))))
    place = np.argsort(orders, axis=1).T                            # (filter, order): position, the inverse
    failed = (np.arange(1 << filters)[:, None] >> np.arange(filters) & 1).astype(bool)
    cost = np.where(failed, 0, filters)                             # min-plus: zero or infinite
    steps = np.minimum((cost[:, :, None] + place[None]).min(axis=1), filters)
    return orders, steps, failed


def word_failures(text: Column) -> list[Column]:
    """Failures A to D of a text (not null)."""
    words = F.filter(F.split(text, GAP), lambda w: w != "")

    def n(count: Column) -> Column:
        return count.cast("long")
    return [F.size(words) < LEAST_WORDS,
            100 * n(F.size(F.array_distinct(words))) < 50 * n(F.size(words)),
            100 * n(F.length(F.regexp_replace(text, "[^A-Z]", ""))) > 2 * n(F.length(text)),
            text.rlike(SIGNS)]


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of each row of `docs`; texts are read once and do not travel.

    Bit k of the mask is failure k of FILTERS. E: some row of smaller doc_id holds the same
    text, told by SHA-256; a row without doc_id is never repeated and repeats nothing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(word_failures(text))]
    facts = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                               F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                               F.unhex(F.sha2(text, 256)).alias("digest"),
                               sum(bits[1:], bits[0]).alias("mask")), "filter-facts")
    # a text's first holder is found by a minimum; it meets its rows by doc_id, so a text of many copies is no hot key
    firsts = facts.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")) \
        .select("doc_id", "digest", F.lit(True).alias("first"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    repeats = F.when(F.col("doc_id").isNull() | F.col("first"), 0).otherwise(1 << 4)
    return (facts.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
            .select("part", (F.col("mask") + repeats).alias("mask"),
                    *[F.coalesce(F.col(c), F.lit(False)).cast("long").alias(c) for c in ("good", "toxic")]))


def scatter(weights: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of all orders and steps of one part, from its counts (weight, mask)."""
    orders, steps, failed = removal_steps(len(FILTERS))
    n = weights[0]
    at = np.arange(len(orders))
    gone = np.zeros((len(weights), len(orders), len(FILTERS) + 1), np.int64)
    for k, w in enumerate(weights):
        np.add.at(gone[k], (at[None], steps), np.broadcast_to(w[:, None], steps.shape))
    removed = gone[0][:, :-1]
    fails = (n @ failed)[orders]                                    # of the filter of each order and step
    alone = (n @ (failed & (failed.sum(1) == 1)[:, None]))[orders]
    # a filter's failures that are not removed at its step were removed at an earlier one
    place = np.argsort(orders, axis=1)
    power = np.take_along_axis(removed, place, axis=1).sum(0)       # by filter, over all orders
    return {"kept": n.sum() - np.cumsum(removed, axis=1), "removed": removed, "redundant": fails - removed,
            "unique_fails": alone, "good_lost": gone[1][:, :-1], "toxic_lost": gone[2][:, :-1], "shapley": power[orders]}


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row per part (value of `source`, null as empty), order of the five filters and step.
    A null text is an empty one; equal rows count each; a doc_id labelled more than once is
    good, or toxic, if one of its labels says so; null labels say nothing. No documents,
    no rows. Columns other than doc_id, text and source, whatever their names, are ignored.
    """
    weights = {f"{c}{m}": F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0))
               for c in WEIGHTS for m in range(1 << len(FILTERS))}
    counts = document_masks(docs, labels).groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = counts.groupBy("part").agg(F.array(*weights.values()).alias("weights"))
    shape = arrow_shape(RESULT)
    orders, _, _ = removal_steps(len(FILTERS))
    names = ["".join(FILTERS[f] for f in o) for o in orders for _ in FILTERS]

    def run(batches):
        for batch in batches:
            for part, flat in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = scatter(np.array(flat, np.int64).reshape(len(WEIGHTS), -1))
                yield pa.RecordBatch.from_pydict({
                    "part": [part] * len(names), "filter_order": names,
                    "step": list(range(1, len(FILTERS) + 1)) * len(orders),
                    **{c: v.ravel() for c, v in got.items()}}, schema=shape)
    return parts.mapInArrow(run, RESULT)


AUDIT_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
       list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
f AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
       len(words) < 200 AS "A", 100 * len(list_distinct(words)) < 50 * len(words) AS "B",
       100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS "C",
       regexp_matches(text, '[#$%&*|]') AS "D",
       coalesce(min(d.doc_id) OVER (PARTITION BY text) < d.doc_id, false) AS "E" FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, ["A", "B", "C", "D", "E"] AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
      FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT m.*, filter_order,
       coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda i: fails[ascii(filter_order[i]) - 64])), 6) AS gone FROM m, o),
p AS (SELECT s.*, step, filter_order[step] AS filter, fails[ascii(filter_order[step]) - 64] AS failed
      FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, any_value(filter) AS filter, sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept,
       sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
       sum(CASE WHEN failed AND gone < step THEN n ELSE 0 END) AS redundant,
       sum(CASE WHEN failed AND len(list_filter(fails, lambda v: v)) = 1 THEN n ELSE 0 END) AS unique_fails,
       sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost,
       sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost FROM p GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
"""
