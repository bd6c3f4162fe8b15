"""Token counts through a digest cache.

A count belongs to the digest of a text and the digest of the tokenizer file, so any
table holding these three columns serves later runs. Of the texts at hand only
distinct ones without a stored count are encoded; their counts are appended to the
cache, and every row takes its count from there by digest.

Counting remembers words: in vocabularies whose pieces hold the word mark only at
their start, no merge crosses a space, so a text's count is the sum over its
space-led units. Other vocabularies are counted text by text.
"""

from __future__ import annotations

import hashlib
from functools import cache as once

import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplake.llm.shared import map_batches, runs, stored, texts
from shoplake.session import scratch_dir

CACHE = "content binary, tokenizer string, n_tokens long"
MEMO_UNITS = 400_000            # units remembered by one task: some 60 MB
MEMO_CHARS = 48
BATCH_CHARS = 1 << 21
_MARK = "▁"


class PieceCounter:
    """Counts of a sentencepiece model, as its library gives them."""

    def __init__(self, path: str):
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        plain = self._ids("a b\nc") == self._ids("a") + self._ids("b\nc")
        self._by_word = plain and not any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces)
        self._line = len(self._ids("\n"))
        self._memo: dict[str, int] = {}

    def _ids(self, text: str) -> list[int]:
        return self._model.encode(text, num_threads=1)

    def count_all(self, many: list[str]) -> list[int]:
        if not self._by_word:
            return [len(self._ids(t)) for t in many]
        whole = {i: len(self._ids(t)) for i, t in enumerate(many) if not t or _MARK in t or "  " in t
                 or t[0] == " " or t[-1] == " "}
        units = [() if i in whole else t.split(" ") for i, t in enumerate(many)]
        memo = self._memo
        fresh = list({u for us in units for u in us if u not in memo})
        found = dict(zip(fresh, self._count_units(fresh), strict=True))
        out = [whole[i] if i in whole else sum([memo.get(u) or found[u] for u in us]) for i, us in enumerate(units)]
        room = MEMO_UNITS - len(memo)
        if room > 0:
            memo.update((u, n) for u, n in list(found.items())[:room] if len(u) <= MEMO_CHARS)
        return out

    def _count_units(self, units: list[str]) -> list[int]:
        return [len(ids) for ids in self._model.encode(units, num_threads=1)]


@once
def counter(path: str) -> PieceCounter:
    """One counter per worker and file."""
    return PieceCounter(path)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def new_cache(spark: SparkSession) -> str:
    """An empty cache table in the shared folder; its path."""
    path = scratch_dir(spark, "token-counts")
    spark.createDataFrame([], CACHE).write.parquet(path)
    return path


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row's whole text; counts go through the cache table at `cache`.

    A null or empty text has no bytes and what the library gives for it; equal rows stay
    and are encoded once; other columns are ignored. An append that failed midway
    leaves no visible rows, and one that ran twice leaves equal rows, which are read as one.
    """
    spark = docs.sparkSession
    cache = cache or new_cache(spark)
    version = file_digest(tokenizer)
    rows = texts(docs).withColumn("content", F.unhex(F.sha2("text", 256)))
    known = (spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
             .groupBy("content").agg(F.first("n_tokens").alias("n_tokens")))
    asked = stored(rows.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    missed = (rows.select("content", "text").dropDuplicates(["content"])
              .join(known.select("content"), "content", "left_anti"))

    def work(content, text):
        counts = [n for part in runs(text, BATCH_CHARS) for n in counter(tokenizer).count_all(part)]
        return {"content": content, "tokenizer": [version] * len(content), "n_tokens": counts}
    map_batches(missed, CACHE, work).write.mode("append").parquet(cache)
    counts = (spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
              .groupBy("content").agg(F.first("n_tokens").alias("n_tokens")))
    return asked.join(counts, "content").select("doc_id", "n_bytes", "n_tokens")
