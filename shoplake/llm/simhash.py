"""SimHash near duplicates by bit-sliced comparison.

Candidates share two of six bands of the fingerprint: four differing bits leave two
bands untouched, so no link is lost (in general radius + 2 bands). Rows of one band
value meet in blocks of bounded size. A block is held vertically, one bit plane per
fingerprint bit, 64 fingerprints to a word; distances of a query to 64 fingerprints
grow in carry-save counters, and blocks whose distances all exceed the radius are
abandoned. Only links that join groups leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplake.llm import bloom
from shoplake.llm.components import components
from shoplake.llm.shared import SLICE_BYTES, map_batches, stored, texts
from shoplake.llm.words import mixed

SEED = 42
BLOCK = 4096                    # fingerprints of one band value that meet in one block
QUERIES = 64                    # compared with a block at a time
SMALL = 8                       # groups up to this size are compared by shifts
CHECK_EVERY = 8                 # bit planes between looks for abandoned blocks


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()      # lowers A-Z; splits at \x20 \x09-\x0D
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = (np.cumsum([len(p) + 1 for p in parts]) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-1]]]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1:], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray, width: int = 1) -> list[int]:
    """SimHash of 64 * width bits as signed longs; zero without hashes. Further words use remixed hashes."""
    out = []
    for k in range(width):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at:at + (1 << 16)]
            if k:
                part = mixed(part + np.uint64(k))
            counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0]))
    return out


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fingerprint long) of each row; a null text counts as empty."""
    return map_batches(texts(docs), "doc_id long, fingerprint long", lambda doc_id, text: {
        "doc_id": doc_id, "fingerprint": [fingerprint(shingle_hashes(t, words))[0] for t in text]})


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Bit planes (64 * width, ceil(n / 64)) of fingerprints (n, width); lane i is bit i % 64 of word i // 64."""
    lanes = -(-len(prints) // 64) * 64
    padded = np.zeros((lanes, prints.shape[1]), np.uint64)
    padded[:len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").copy().view(np.uint64)


def _near(flipped: Iterator[np.ndarray], bits: int, shape: tuple[int, int], radius: int) -> np.ndarray:
    """Words with a bit set for each lane whose set bits over all planes are at most `radius`.

    `flipped` gives planes of differing bits for the rows still alive, told by `send`.
    """
    depth = (radius + 1).bit_length()
    rows = np.arange(shape[0])
    counters = [np.zeros(shape, np.uint64) for _ in range(depth)]
    over = np.zeros(shape, np.uint64)
    out = np.zeros(shape, np.uint64)
    plane = next(flipped)
    for k in range(bits):
        carry = plane
        for c in counters:                      # ripple of half adders over all lanes at once
            c ^= carry
            carry = carry & ~c
        over |= carry
        if k % CHECK_EVERY == CHECK_EVERY - 1 or k == bits - 1:
            past = over | _exceeds(counters, radius)
            alive = (~past).any(axis=1)
            if k == bits - 1:
                out[rows] = ~past
                break
            if not alive.any():
                break
            if not alive.all():
                rows, counters, over = rows[alive], [c[alive] for c in counters], over[alive]
        plane = flipped.send(rows)
    flipped.close()
    return out


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius: compared bit by bit from the top."""
    above = np.zeros_like(counters[0])
    equal = ~above
    for bit in reversed(range(len(counters))):
        if radius >> bit & 1:
            equal &= counters[bit]
        else:
            above |= equal & counters[bit]
            equal &= ~counters[bit]
    return above


def near_lanes(queries: np.ndarray, planes: np.ndarray, n: int, radius: int) -> np.ndarray:
    """Boolean (queries, n): which fingerprints of a block differ in at most `radius` bits."""
    def flipped() -> Iterator[np.ndarray]:
        rows = np.arange(len(queries))
        for k in range(len(planes)):
            ones = (np.uint64(0) - (queries[rows, k // 64] >> np.uint64(k % 64) & np.uint64(1)))[:, None]
            rows = (yield planes[k] ^ ones)
    near = _near(flipped(), len(planes), (len(queries), planes.shape[1]), radius)
    return np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def near_pairs(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Boolean per pair: the same counters, one lane per pair."""
    planes = planes_of(x ^ y)

    def flipped() -> Iterator[np.ndarray]:
        rows = np.arange(planes.shape[1])
        for k in range(len(planes)):
            rows = (yield planes[k][rows][:, None])
    near = _near(flipped(), len(planes), (planes.shape[1], 1), radius)
    return np.unpackbits(near.view(np.uint8), bitorder="little")[:len(x)].astype(bool)


def group_links(group: np.ndarray, side: np.ndarray, prints: np.ndarray, sets: ShingleSets | None, ids: np.ndarray,
                radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows sorted by group, of near fingerprints and, if given, similar sets; few
    shingles are compared whatever their fingerprints. A small group gives all its pairs; each linked set of a larger one is a star."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    small = np.repeat(sizes <= SMALL, sizes)
    for shift in range(1, SMALL):
        a = np.flatnonzero(small[shift:] & (group[shift:] == group[:-shift]))
        two = np.repeat(np.maximum.reduceat(side, starts), sizes)[a] > 0        # two parts: compare across only
        a = a[~two | (side[a] != side[a + shift])]
        if not a.size:
            continue
        near = near_pairs(prints[a], prints[a + shift], radius)
        a = a[near | sets.few[a] | sets.few[a + shift]] if sets else a[near]
        if sets:
            a = a[np.array([sets.similar(x, np.array([x + shift]))[0] for x in a], bool)]
        yield ids[a], ids[a + shift]
    for g in np.flatnonzero(sizes > SMALL):
        part = slice(starts[g], starts[g] + sizes[g])
        p, i, s = prints[part], ids[part], side[part]
        cross = s.any()
        asked = np.flatnonzero(s == 0)
        held = np.flatnonzero(s == 1) if cross else asked
        planes, label = planes_of(p[held]), np.arange(len(p))
        for at in range(0, len(asked), QUERIES):
            q = asked[at:at + QUERIES]
            near = near_lanes(p[q], planes, len(held), radius)
            if sets:
                near |= sets.few[starts[g] + q][:, None] | sets.few[starts[g] + held]
            for row in np.flatnonzero(near.any(axis=1)):
                others = held[near[row]]
                if sets:                        # sets are compared only where that may join two stars
                    others = others[(label[others] != label[q[row]]) & (cross | (others > q[row]))]
                    others = others[sets.similar(starts[g] + q[row], starts[g] + others)]
                tied = np.unique(np.r_[label[q[row]], label[others]])
                if len(tied) > 1:
                    label[np.isin(label, tied)] = tied[0]
        tied = np.flatnonzero(label != np.arange(len(p)))
        yield i[tied], i[label[tied]]


class ShingleSets:
    """Sets of hashes as one array and its offsets; renumbered, so that a set is a row of flags."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.at, self.least = np.cumsum([0, *[len(s) for s in sets]]), similarity
        names, self.values = np.unique(np.concatenate(sets), return_inverse=True)
        self.few = np.diff(self.at) <= FEW
        self.flags = np.zeros(len(names), bool)

    def similar(self, row: int, others: np.ndarray) -> np.ndarray:
        """Which of `others` have a Jaccard similarity to `row` of at least the bound."""
        out = np.zeros(len(others), bool)
        n, sizes = self.at[row + 1] - self.at[row], self.at[others + 1] - self.at[others]
        fit = np.flatnonzero(np.minimum(n, sizes) >= self.least * np.maximum(n, sizes))
        if len(fit):
            mine = self.values[self.at[row]:self.at[row + 1]]
            self.flags[mine] = True
            hits = self.flags[np.concatenate([self.values[self.at[o]:self.at[o + 1]] for o in others[fit]])]
            self.flags[mine] = False
            common = np.add.reduceat(hits, np.r_[0, np.cumsum(sizes[fit])[:-1]], dtype=np.int64)
            out[fit] = common >= self.least * (n + sizes[fit] - common)
        return out


def _links(radius: int, compared: Callable[[pa.Table], tuple[np.ndarray, ShingleSets | None]]):
    """Arrow task: rows (block, side, id, ...) sorted by block in, links out; a block may run over
    batches. `compared` makes fingerprints, and sets if those count, of the rows of some blocks."""
    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy()
            cut = int(np.searchsorted(block, block[-1]))        # the last block may go on
            if held and (cut or block[0] != held[0].column(0)[0].as_py()):
                yield from emit([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield from emit([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield from emit(held)
        pa.default_memory_pool().release_unused()

    def emit(batches):
        rows = pa.Table.from_batches(batches).combine_chunks()
        block = rows.column(0).to_numpy()
        cuts = [*np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist(), len(block)]
        sizes = np.full(len(block), 64)
        if "text" in rows.schema.names:
            sizes += pc.binary_length(rows.column("text")).to_numpy()
        ends = np.r_[0, np.cumsum(sizes)][cuts]
        begin = 0
        for i in range(1, len(cuts)):                           # some blocks at a time
            if i + 1 < len(cuts) and ends[i + 1] - ends[begin] <= SLICE_BYTES:
                continue
            part = rows.slice(cuts[begin], cuts[i] - cuts[begin])
            group, side, ids = (part.column(k).to_numpy() for k in range(3))
            for a, b in group_links(group, side, *compared(part), ids, radius):
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": a, "b": b})
            begin = i

    return run


def stored_prints(rows: pa.Table) -> tuple[np.ndarray, None]:
    """The fingerprints that the rows carry."""
    return np.stack([rows.column(k).to_numpy().astype(np.int64).view(np.uint64) for k in range(3, rows.num_columns)], axis=1), None


def _bands(radius: int, fp: Column) -> list[Column]:
    """Keys of which two fingerprints within the radius share one: pairs of radius + 2 bands."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(n)]
    keys = []
    for t, (i, j) in enumerate(combinations(range(n), 2)):
        mask = masks[i] | masks[j]
        mask -= 1 << 64 if mask >> 63 else 0
        keys.append(F.xxhash64(F.lit(t), fp.bitwiseAND(F.lit(mask).cast("long"))))
    return keys


def blocks(keyed: DataFrame, busy: DataFrame) -> DataFrame:
    """(block, side, id): the rows of `keyed` (key, id) whose key is in `busy` (key, parts).

    A key is cut into its parts by a hash; each pair of parts is a block of its own, so
    no task holds more than two parts.
    """
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    return (keyed.join(busy, "key").select("key", "id", part.alias("part"), other)
            .select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("block"),
                    F.when(F.col("part") > F.col("other"), 1).otherwise(0).alias("side"), "id"))


def block_links(rows: DataFrame, radius: int, compared=stored_prints) -> DataFrame:
    """(a, b) links between the rows (block, side, id, what `compared` reads) of each block."""
    return (rows.repartition("block").sortWithinPartitions("block", "side", "id")
            .mapInArrow(_links(radius, compared), "a long, b long"))


def simhash_components(docs: DataFrame, words: int, radius: int) -> DataFrame:
    """(doc_id, fingerprint long, component_id): documents linked by fingerprints at most `radius` bits apart.

    The component is its smallest doc_id. Texts without words (null, empty, blank) have
    fingerprint zero and link like any other; shorter texts than `words` count whole.
    Rows of one fingerprint are compared once, by their smallest doc_id. Other columns
    are ignored; equal rows stay; an empty table gives none.
    """
    prints = stored(fingerprints(docs, words), "fingerprints")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("id")), "distinct-prints")
    bands = F.array(*_bands(radius, F.col("fingerprint")))
    keyed = stored(distinct.where("id is not null").select("id", F.explode(bands).alias("key")), "keyed-prints")
    busy = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                  .select("key", F.ceil(F.col("n") / BLOCK).alias("parts")), "busy-keys")
    rows = blocks(keyed, busy).join(distinct, "id").select("block", "side", "id", "fingerprint")
    links = block_links(rows, radius)
    roots = components(stored(links, "print-links"), "print-components")
    named = distinct.join(roots, F.col("id") == F.col("node"), "left").select(
        "fingerprint", F.coalesce("component", "id").alias("component_id"))
    return prints.join(stored(named, "named-prints"), "fingerprint").select("doc_id", "fingerprint", "component_id")


WIDTH = 4                       # words of the fingerprint that similar texts are compared by
REACH = 60                      # of 256 bits; two sets of similarity 0.8 have 39 on average, deviation 6
FEW = 64                        # shingles of a set that is compared without a look at its fingerprint
KEYS, KEY_MINIMA = 16, 4        # a pair of similarity 0.8 shares a key with a chance of 0.9998
BLOCK_SHINGLES = 1 << 22        # of one key that meet in one block


def block_keys(hashes: np.ndarray) -> list[int]:
    """KEYS hashes, each of KEY_MINIMA least shingle hashes under one multiplier each; none without shingles."""
    if not len(hashes):
        return []
    factors = np.random.default_rng(SEED).integers(1, 1 << 63, KEYS * KEY_MINIMA, dtype=np.uint64) | np.uint64(1)
    least = np.full(len(factors), ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (mixed(hashes[at:at + 4096])[:, None] * factors).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(KEYS, KEY_MINIMA))]


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): documents tied by a Jaccard similarity of word shingles of at least `similarity`.

    Documents that share a key of least shingle hashes meet in blocks; keys with the same
    members make one block. There bit-sliced SimHash of the shingle sets (256 bits, REACH)
    leaves the near ones, whose sets are compared exactly, as are those of FEW shingles. Every near pair of a block is compared
    unless its two are tied already, and only ties leave the task. Equal texts are one
    from the start. Texts without words are tied to each other only where equal; a shorter
    text than `words` is one shingle. Other columns are ignored; an empty table gives none.
    """
    found = texts(docs).withColumn("id", F.xxhash64("text", F.octet_length("text"), F.crc32("text")))

    def keys(doc_id, id, text):
        hashes = [shingle_hashes(t, words) for t in text]
        return {"doc_id": doc_id, "id": id, "size": [len(h) for h in hashes], "keys": [block_keys(h) for h in hashes]}
    named = stored(map_batches(found.select("doc_id", "id", "text"),
                               "doc_id long, id long, size long, keys array<long>", keys), "block-keys")
    distinct = stored(named.groupBy("id").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"),
                                              F.first("keys").alias("keys")), "distinct-texts")
    keyed = stored(distinct.select("id", "size", F.explode("keys").alias("key")), "keyed-texts")
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared-keys")
    keyed = stored(keyed.join(shared, "key", "left_semi"), "shared-texts")      # few rows: wide sums are of these only
    members = [F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"),
               F.bit_xor(F.xxhash64("id")).alias("mix"), F.bit_xor(F.xxhash64("id", F.lit(SEED))).alias("mix2")]
    busy = stored(keyed.groupBy("key").agg(*members, F.sum("size").alias("size"))
                  .groupBy("n", "low", "high", "mix", "mix2", "size").agg(F.min("key").alias("key"))
                  .select("key", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_SHINGLES)).alias("parts")),
                  "busy-keys")
    placed = stored(blocks(keyed, busy), "block-rows")
    # texts of the rows in blocks travel, all others stay: a filter picks one row of each text, the join is exact
    key = F.xxhash64("id", "doc_id")
    asked = stored(distinct.join(placed.select("id").distinct(), "id", "left_semi")
                   .select("id", F.col("first").alias("doc_id")).select(key.alias("key")), "asked")
    near = bloom.keep(found.withColumn("key", key), "key", bloom.build(asked)).select("id", "text").dropDuplicates(["id"])

    def compared(rows: pa.Table) -> tuple[np.ndarray, ShingleSets]:
        sets: dict[int, np.ndarray] = {}
        ids = rows.column("id").to_pylist()
        for id_, t in zip(ids, rows.column("text").to_pylist(), strict=True):
            if id_ not in sets:
                sets[id_] = np.unique(shingle_hashes(t, words))
        prints = {i: fingerprint(h, WIDTH) for i, h in sets.items()}
        return (np.array([prints[i] for i in ids], np.int64).view(np.uint64).reshape(-1, WIDTH),
                ShingleSets([sets[i] for i in ids], similarity))
    links = block_links(placed.join(near, "id").select("block", "side", "id", "text"), REACH, compared)
    roots = components(stored(links, "similar-pairs"), "similar-components")
    tied = stored(distinct.join(roots, F.col("id") == F.col("node"), "left")
                  .select("id", "first", F.coalesce("component", "id").alias("root")), "tied-texts")
    least = stored(tied.groupBy("root").agg(F.min("first").alias("component_id")), "first-of-each")
    return named.join(stored(tied.join(least, "root").select("id", "component_id"), "named-texts"), "id") \
        .select("doc_id", "component_id")


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs`, all columns, without the documents that are tied to one of smaller doc_id; a null doc_id stays.

    Rows that share a doc_id stay or go together.
    """
    later = similar_documents(docs, words, similarity).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(stored(later, "near-copies"), "doc_id", "left_anti").select(*docs.columns)
