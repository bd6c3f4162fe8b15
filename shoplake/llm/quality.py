"""Quality classifier: averaged embeddings of hashed words and character n-grams, softmax output.

A document is the mean of the learned vectors of its hashed words, word pairs and
character n-grams; a softmax layer over the two classes gives the score. Vectors and layer are
trained together by stochastic gradient descent in numpy on a bounded sample of
labelled rows. A trained model is linear in the mean, so scoring needs one number per
bucket: it is a table of `BUCKETS` floats, sent to the tasks, which read every text once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplake.llm.shared import map_batches, slices, stored, texts
from shoplake.llm.words import SOLID_BYTES, batches, mixed, word_hashes

BUCKETS = 1 << 16               # hashed features
SIZE = 8                        # of an embedding
TRAIN_ROWS = 2000               # labelled rows fitted on, at most
TRAIN_BYTES = 256 << 20         # of their features, at most: what the driver receives
EPOCHS = 6
RATE = 0.5
VECTOR_RATE = 20                # times RATE: a mean passes on a small share of its gradient
GRAMS = (2, 4)                  # characters
PART_CHARS = 1 << 18            # text whose features are held at a time; a longer text stands alone
REPEATED = np.uint64(0x5EED)    # one feature for any word that follows itself
SEED = 7


def _grams(data: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of all runs of n characters that stay inside a text."""
    first = np.flatnonzero((data & 0xC0) != 0x80)       # first byte of each character; line feeds close the texts
    owner = np.searchsorted(begins, first, "right") - 1
    wide = data.astype(np.uint32)
    point = wide[first]
    for k in range(1, 4):                               # further bytes of a character, if they are its own
        at = np.minimum(first + k, len(data) - 1)
        more = (data[at] & 0xC0) == 0x80
        for j in range(1, k):
            more &= (data[np.minimum(first + j, len(data) - 1)] & 0xC0) == 0x80
        point = np.where(more, point << np.uint32(8) | wide[at], point)
    count = len(first) - n + 1
    if count < 1:
        return np.zeros(0, np.uint64), owner[:0]
    inside = owner[:count] == owner[n - 1:]
    inside &= first[n - 1:] < begins[owner[:count] + 1] - 1         # not over the closing line feed
    gram = np.full(count, n, np.uint64)
    for k in range(n):
        gram = mixed(gram ^ point[k:count + k])
    return gram[inside], owner[:count][inside]


def _features(data: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of the features of the joined texts, one kind after another."""
    def bucket(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(7) & np.uint64(BUCKETS - 1)).astype(np.int32)

    starts, words = word_hashes(data, SOLID_BYTES)
    owner = np.searchsorted(begins, starts, "right") - 1
    yield bucket(words), owner
    pair = owner[1:] == owner[:-1]
    pairs = np.where(words[1:] == words[:-1], REPEATED, words[:-1] * np.uint64(3) + words[1:])
    yield bucket(pairs[pair]), owner[1:][pair]
    for n in GRAMS:
        grams, owner = _grams(data, begins, n)
        yield bucket(grams), owner


def bags(many: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text."""
    out = []
    for _, data, begins in batches(many, PART_CHARS):
        key = np.concatenate([owner.astype(np.int64) * BUCKETS + bucket for bucket, owner in _features(data, begins)])
        n = len(begins) - 1
        key, count = np.unique(key, return_counts=True)
        cuts = np.searchsorted(key, np.arange(n + 1) * BUCKETS)
        out += [((key[a:b] % BUCKETS).astype(np.int32), count[a:b].astype(np.float32))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


@dataclass
class Model:
    weight: np.ndarray          # of each bucket, for the log odds of label 1
    bias: float

    def scores(self, many: list[str]) -> list[float]:
        out: list[float] = []
        for _, data, begins in batches(many, PART_CHARS):
            n = len(begins) - 1
            total, count = np.zeros(n), np.zeros(n)
            for bucket, owner in _features(data, begins):
                total += np.bincount(owner, self.weight[bucket], n)
                count += np.bincount(owner, minlength=n)
            mean = total / np.maximum(count, 1)
            out += (1 / (1 + np.exp(-np.clip(mean + self.bias, -60, 60)))).tolist()
        return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Fit by SGD; without rows every text scores one half."""
    dice = np.random.default_rng(SEED)
    vectors = dice.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE))
    layer, bias = np.zeros((2, SIZE)), np.zeros(2)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in dice.permutation(len(rows)):
            rate = RATE * (1 - done / steps)
            done += 1
            at, count = rows[i]
            share = count / max(count.sum(), 1)
            mean = share @ vectors[at]
            odds = layer @ mean + bias
            off = np.exp(odds - odds.max())
            off /= off.sum()
            off[labels[i]] -= 1
            pull = layer.T @ off
            layer -= rate * np.outer(off, mean)
            bias -= 0.1 * rate * off
            if len(at):
                vectors[at] -= VECTOR_RATE * rate * share[:, None] * pull
    slope = layer[1] - layer[0]
    return Model((vectors @ slope).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of `labels` (doc_id, quality 0/1) over the texts of `docs`.

    At most `rows` labelled rows are used, those of lowest hash of doc_id, and of these the
    first whose features fit in TRAIN_BYTES together, so repeated runs agree. Null labels and ids are left out; a doc_id labelled twice counts once,
    with its smaller label; repeated documents count as often as they occur, within the bound.
    """
    picked = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
              .agg(F.min("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(rows))
    found = texts(docs).join(F.broadcast(picked), "doc_id")      # `rows` rows at most

    def work(doc_id, quality, text):
        got = bags(text)
        return {"doc_id": doc_id, "quality": quality, "at": [g[0].tobytes() for g in got],
                "count": [g[1].tobytes() for g in got]}
    bagged = stored(map_batches(found.select("doc_id", "quality", "text"), "doc_id long, quality int, at binary, count binary", work)
                    .withColumns({"order": F.xxhash64("doc_id"), "size": F.length("at") + F.length("count")}), "bags")
    sizes = bagged.groupBy("order", "doc_id").agg(F.sum("size").alias("size")).orderBy("order", "doc_id").limit(rows).collect()
    held = np.cumsum([r["size"] for r in sizes])
    fit_in = [r["doc_id"] for r, upto in zip(sizes, held, strict=True) if upto <= TRAIN_BYTES]
    rows_ = bagged.where(F.col("doc_id").isin(fit_in)).select("doc_id", "quality", "at", "count").toArrow()
    rows_ = rows_.sort_by([("doc_id", "ascending")]).slice(0, rows)
    unpack = [(np.frombuffer(a, np.int32), np.frombuffer(c, np.float32))
              for a, c in zip(rows_["at"].to_pylist(), rows_["count"].to_pylist(), strict=True)]
    return train(unpack, rows_["quality"].to_numpy().astype(int))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score double) of each row's whole text; a null or empty text scores by the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_batches(texts(docs), "doc_id long, score double",
                       lambda doc_id, text: {"doc_id": doc_id, "score": shared.value.scores(text)})


def keep_good(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores at least `least`.

    A null text scores as an empty one; equal rows score alike, so all stay or all go; an
    empty table stays empty. The text is the column `text`; other columns may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(found):
        for batch in slices(found):
            many = [t or "" for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(np.array(shared.value.scores(many)) >= least))
        pa.default_memory_pool().release_unused()
    return docs.mapInArrow(run, docs.schema)
