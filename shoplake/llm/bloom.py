"""Bloom filters of longs, sized from the number of keys within a bound.

A filter only spares work: what it lets through is joined exactly. Past the bound it
fills up and spares less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplake.llm.shared import map_batches
from shoplake.llm.words import mixed

LEAST_BITS, MOST_BITS = 18, 27  # as powers of two: 32 kB to 16 MB
BITS_A_KEY = 256                # with three probes, some two in a million other keys pass
PROBES = 3


class Bloom:
    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys (unsigned) that may be in it; all others are not."""
        at = np.arange(len(keys))
        for k in range(PROBES):
            slot = slots(keys[at], self.bits, k)
            at = at[self.table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0]
        return at


def slots(keys: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return (mixed(keys + np.uint64(probe)) >> np.uint64(64 - bits)).astype(np.int64)


def build(keys: DataFrame) -> Bloom:
    """The filter of the column `key` (long, not null) of a stored table.

    The driver receives 2^21 short rows at most. Past half a million keys fewer bits are left for each.
    """
    bits = max(LEAST_BITS, min(MOST_BITS, (BITS_A_KEY * max(1, keys.count()) - 1).bit_length()))

    def work(key):
        unsigned = np.array(key, np.int64).view(np.uint64)
        found = np.unique(np.concatenate([slots(unsigned, bits, k) for k in range(PROBES)]))
        return {"word": (found >> 6).tolist(), "bit": (found & 63).tolist()}
    rows = (map_batches(keys.select("key"), "word long, bit int", work).groupBy("word")
            .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow())
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return Bloom(bits, table.view(np.uint8))


def keep(df: DataFrame, key: str, bloom: Bloom) -> DataFrame:
    """The rows whose `key` (long, not null) may be in the filter."""
    shared, at = df.sparkSession.sparkContext.broadcast(bloom), df.columns.index(key)

    def run(batches):
        for batch in batches:
            yield batch.take(pa.array(shared.value.may_hold(batch.column(at).to_numpy().view(np.uint64))))
    return df.mapInArrow(run, df.schema)
