"""Benchmark decontamination by spaced-seed hashing.

A seed hashes the words at fixed places of a short span and ignores the others, so it
survives substitutions there. The two masks hit every window of LENGTH words with up
to two substituted words, wherever they fall (a test counts all cases). Seeds of
documents and of benchmark items meet in a join; around each hit the words are
compared one by one, and an overlap counts if LENGTH words in a row agree in LEAST.
Items of fewer words have one seed, of all their words, and count where all agree.

Documents are scanned once. A Bloom filter made from the benchmark's seeds and sized by
their number decides which stretches of a document may match, so only those are stored and
joined; it errs on one side only, whatever the size of the benchmark. The join pairs a
stretch with an item once, however often their seeds repeat; places are found in the pair.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplake.llm import bloom
from shoplake.llm.bloom import Bloom
from shoplake.llm.shared import arrow_shape, map_batches, stored, texts
from shoplake.llm.words import WORD_BYTES, batches, mixed, word_hashes

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
LENGTH = 13                     # words of the shortest overlap
LEAST = 11                      # of them equal: at least 0.8

STRETCH = "doc_id long, start int, words array<long>, seeds array<long>"
OVERLAP = "doc_id long, item_id long, doc_word int, item_word int, n_words int, n_equal int"


def seeds_of(words: np.ndarray, mask: int) -> np.ndarray:
    """Seed hash at each word that starts a span."""
    n = max(0, len(words) - SPAN + 1)
    total = np.full(n, mask + 1, np.uint64)
    for k, at in enumerate(MASKS[mask]):
        total += words[at:at + n] * np.uint64(2 * k + 3) ^ (words[at:at + n] >> np.uint64(17 + k))
    return mixed(total)


def spans_of(words: np.ndarray, most: int) -> list[np.ndarray]:
    """Seed hashes of all spans of n words, by start, for n = 1 to `most`."""
    out = [mixed(words ^ np.uint64(len(MASKS) + 1))]
    for n in range(2, most + 1):
        out.append(mixed(out[-1][:-1] * np.uint64(5) + words[n - 1:] + np.uint64(n)))
    return out


def benchmark_words(items: DataFrame) -> DataFrame:
    """(item_id, words array<long>) of items with words; equal ones count as the smallest id."""
    def work(doc_id, text):
        words: list[list[int]] = []
        for _, data, begins in batches(text):
            starts, hashes = word_hashes(data, WORD_BYTES, unspaced=True)
            cuts = np.searchsorted(starts, begins)
            words += [hashes[a:b].view(np.int64).tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return {"item_id": doc_id, "words": words}
    lowered = texts(items, "item_id").withColumn("text", F.lower("text"))
    return (map_batches(lowered, "item_id long, words array<long>", work).where(F.size("words") > 0)
            .groupBy("words").agg(F.min("item_id").alias("item_id")).select("item_id", "words"))


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """Distinct (key, item_id): seeds of benchmark words; a single seed for fewer than LENGTH."""
    def work(item_id, words):
        out: dict[str, list] = {"key": [], "item_id": []}
        for item, w in zip(item_id, words, strict=True):
            words = np.array(w, np.int64).view(np.uint64)
            for seeds in spans_of(words, len(w))[-1:] if len(w) < LENGTH else map(partial(seeds_of, words), range(len(MASKS))):
                out["key"] += np.unique(seeds).view(np.int64).tolist()
                out["item_id"] += [item] * (len(out["key"]) - len(out["item_id"]))
        return out
    return map_batches(items, "key long, item_id long", work).distinct()


def stretches(docs: DataFrame, known: Broadcast, short: list[int]) -> DataFrame:
    """Parts of documents with suspected seeds, with LENGTH words of context on both sides; and, for each
    length in `short`, the first place of each suspected span of so many words."""
    def rows_of(many: list[str], ids: list[int], known: Bloom) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("doc_id", "start", "words", "seeds")}
        for first, data, begins in batches(many):
            starts, words = word_hashes(data, WORD_BYTES, unspaced=True)
            cuts = np.searchsorted(starts, begins)
            owner = np.repeat(np.arange(len(begins) - 1), np.diff(cuts))
            spans = spans_of(words, min(max(short, default=0), len(words)))
            for n in short:
                if n > len(words):
                    continue
                hit = known.may_hold(spans[n - 1])
                hit = hit[owner[hit] == owner[hit + n - 1]]
                _, once = np.unique(np.stack((owner[hit].astype(np.uint64), spans[n - 1][hit])), axis=1, return_index=True)
                for a in hit[once]:
                    out["doc_id"].append(ids[first + owner[a]])
                    out["start"].append(int(a - cuts[owner[a]]))
                    out["words"].append(words[a:a + n].view(np.int64).tolist())
                    out["seeds"].append(spans[n - 1][a:a + 1].view(np.int64).tolist())
            at, seed = [], []
            for mask in range(len(MASKS)):
                seeds = seeds_of(words, mask)
                hit = known.may_hold(seeds)
                hit = hit[owner[hit] == owner[hit + SPAN - 1]]
                at.append(hit)
                seed.append(seeds[hit])
            at, seed = np.concatenate(at), np.concatenate(seed)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, seed = at[order], seed[order]
            breaks = np.flatnonzero((np.diff(at) > 2 * LENGTH) | (np.diff(owner[at]) > 0)) + 1
            for part in np.split(np.arange(len(at)), breaks):
                doc = owner[at[part[0]]]
                low = max(cuts[doc], at[part[0]] - LENGTH)
                high = min(cuts[doc + 1], at[part[-1]] + SPAN + LENGTH)
                out["doc_id"].append(ids[first + doc])
                out["start"].append(int(low - cuts[doc]))
                out["words"].append(words[low:high].view(np.int64).tolist())
                out["seeds"].append(np.unique(seed[part]).view(np.int64).tolist())
        return out

    def work(doc_id, text):
        return rows_of(text, doc_id, known.value)
    return map_batches(texts(docs).withColumn("text", F.lower("text")), STRETCH, work)


def shifts_of(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Alignments (place in `words` less place in `item`) at which a seed of both agrees; only 0 for a short item.

    Repeated seeds cost the product of their places in time, not in memory.
    """
    if len(item) < LENGTH:
        return np.zeros(int(len(words) == len(item)), np.int64)
    marks = np.zeros(len(words) + len(item), bool)
    for mask in range(len(MASKS)):
        here, there = seeds_of(words, mask), seeds_of(item, mask)
        order = np.argsort(here, kind="stable")
        for at, seed in enumerate(there):
            low, high = np.searchsorted(here, seed, sorter=order), np.searchsorted(here, seed, "right", sorter=order)
            marks[order[low:high] - at + len(item)] = True
    return np.flatnonzero(marks) - len(item)


def longest_overlap(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
    """(first word, first item word, words, equal ones) of the longest overlap at one alignment, or None.

    It is the longest run of windows of LENGTH words of which LEAST agree, without
    disagreeing words at its ends. A shorter item overlaps as a whole or not at all.
    """
    if len(item) < LENGTH:
        whole = shift >= 0 and np.array_equal(words[shift:shift + len(item)], item)
        return (shift, 0, len(item), len(item)) if whole else None
    low, high = max(0, -shift), min(len(item), len(words) - shift)
    if high - low < LENGTH:
        return None
    same = words[low + shift:high + shift] == item[low:high]
    sums = np.concatenate(([0], np.cumsum(same)))
    good = np.concatenate(([False], sums[LENGTH:] - sums[:-LENGTH] >= LEAST, [False]))
    flips = np.flatnonzero(good[1:] != good[:-1])
    best = None
    for a, b in zip(flips[::2], flips[1::2] + LENGTH - 1, strict=True):
        inner = np.flatnonzero(same[a:b])
        a, b = a + inner[0], a + inner[-1] + 1
        if best is None or b - a > best[2]:
            best = (int(low + a + shift), int(low + a), int(b - a), int(same[a:b].sum()))
    return best


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, n_equal): the longest overlap of each document and item.

    Words are lower-cased runs of letters and digits (all beyond ASCII included but STOPS);
    in scripts without spaces, characters. Items of fewer than LENGTH words overlap where all
    their words follow each other; null and empty texts overlap with nothing; of items with
    equal words the smallest item_id stands for all; rows that share a doc_id count as
    one document; other columns are ignored.
    """
    known = stored(benchmark_words(items), "benchmark-words")
    seeds = stored(benchmark_seeds(known), "benchmark-seeds")
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom.build(seeds))
    short = [r[0] for r in known.select(F.size("words")).where(F.size("words") < LENGTH).distinct().collect()]
    parts = stored(stretches(docs, filter_, short).withColumn("stretch", F.monotonically_increasing_id()), "stretches")
    pairs = (parts.select("stretch", F.explode("seeds").alias("key")).join(seeds, "key")
             .select("stretch", "item_id").distinct())
    found = (pairs.join(known.withColumnRenamed("words", "item"), "item_id")
             .join(parts.drop("seeds"), "stretch"))

    shape = arrow_shape(OVERLAP)

    def check(batches):
        for batch in batches:
            words_of, item_of = (batch.column(batch.schema.names.index(c)) for c in ("words", "item"))
            out = []
            for i, (doc, item_id, start) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True)):
                words = words_of[i].values.to_numpy().view(np.uint64)
                item = item_of[i].values.to_numpy().view(np.uint64)
                got = [g for s in shifts_of(words, item) if (g := longest_overlap(words, item, s))]
                if got:
                    at, item_at, n, equal = max(got, key=lambda g: (g[2], g[3], -g[0]))
                    out.append({"doc_id": doc, "item_id": item_id, "doc_word": at + start,
                                "item_word": item_at, "n_words": n, "n_equal": equal})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=shape)
    hits = found.select("doc_id", "item_id", "start", "words", "item").mapInArrow(check, OVERLAP)
    best = F.max_by(F.struct("doc_word", "item_word", "n_words", "n_equal"),
                    F.struct("n_words", "n_equal", -F.col("doc_word")))
    return (hits.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`docs`, all columns, without the documents that overlap with an item; a null doc_id stays.

    Rows that share a doc_id stay or go together; a null or empty text stays. No items, or
    no documents, leave all. Columns other than doc_id and text may have any name.
    """
    bad = overlaps(docs, items).select("doc_id").distinct()
    return docs.join(stored(bad, "contaminated"), "doc_id", "left_anti").select(*docs.columns)
