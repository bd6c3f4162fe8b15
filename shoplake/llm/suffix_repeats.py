"""Repeated byte strings across documents: maximal repeats of an enhanced suffix array, in buckets.

A suffix array of the whole corpus cannot be cut into tasks, one of anchored suffixes
can. Anchors are minimizers: every string of `length` bytes holds one, chosen by the
string's own bytes, so equal strings hold the same anchor at the same place. Suffixes
that start at equal anchors meet in one task, each with the bytes that any string of
`length` bytes through the anchor can reach, to the right and to the left.

There they are sorted, and a stack scan over the common prefixes of neighbours yields
the intervals of the prefix tree. The rows of an interval are then sorted by what
precedes them; the same scan over the common left extensions, split where they
diverge, gives maximal repeats with all their occurrences.

Most anchors occur once, so only digests of all anchors are compared at first: eleven
bytes for the anchor and its surroundings. Where the surroundings are equal too, the
larger documents lose them at once. Only where an anchor has several surroundings do
the bytes travel, once for each of them. Both travel packed, one binary value per task
batch and bucket; and a passage common to many documents about once per batch.

An anchor with very many surroundings would make a task of its own. Counters of fixed size
(a count-min sketch) tell such hot anchors beforehand, and never miss one. Their strings of
`length` bytes compete one by one instead, spread by their own hashes: the smallest document
of each is a minimum, taken per batch first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplake.llm.shared import arrow_shape, map_batches, slices, stored, texts
from shoplake.llm.words import _power, batches, mixed

ANCHOR = 22                     # bytes of an anchor
BUCKET_BYTES = 4 << 20          # text per bucket
BATCH_CHARS = 2 << 20
NOTE = 20                       # bits for a span's length in a packed span
MARK = 48                       # bits of the digest of an anchor with its surroundings
HOT_ROWS = 200_000              # surroundings of an anchor from which on it is hot, but at least
COUNTERS = 20                   # 8 / 2^COUNTERS of all; bits, for two rows of counters: 16 MB
PACKED = "bucket long, payload binary"
MARKS = "doc_id long, mark long"     # digest << 1 | 1 if the bytes are asked for, 0 if they go
SPANS = "doc_id long, span long"    # start << NOTE | length
PARTS = 64                      # that the counters are added up in


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbouring values."""
    size, out = 1, h
    while 2 * size <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:len(h) - w + 1], out[w - size:len(h) - size + 1]) if len(h) >= w else out[:0]


def anchors(data: np.ndarray, begins: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(place, hash, text, bytes reached to the left, to the right, digest of all reached) of the anchors
    of joined texts: the smallest anchor hashes of any `length` bytes of one text."""
    w, reach = length - ANCHOR + 1, length - ANCHOR
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in ("i8", "u8", "i8", "i8", "i8", "i8"))
    up, down = _power(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])))
    n = len(data) - ANCHOR + 1
    h = mixed((sums[ANCHOR:] - sums[:n]) * down[:n]) | np.uint64(1)
    least = _window_min(h, w)
    inside = np.zeros(len(least) + 1, np.int64)          # windows within one text
    low, high = begins[:-1], begins[1:] - 1 - length + 1
    some = high > low
    np.add.at(inside, low[some], 1)
    np.add.at(inside, high[some], -1)
    least = np.where(np.cumsum(inside[:-1]) > 0, least, np.uint64(0))
    edge = np.zeros(w - 1, np.uint64)
    most = ~_window_min(~np.concatenate((edge, least, edge)), w)
    at = np.flatnonzero(most == h)
    owner = np.searchsorted(begins, at, "right") - 1
    left = np.minimum(at - begins[owner], reach)
    right = np.minimum(begins[owner + 1] - 1 - at - ANCHOR, reach)
    mark = mixed((sums[at + ANCHOR + right] - sums[at - left]) * down[at - left] + (left << 8 | right).astype(np.uint64))
    return at, h[at], owner, left, right, (mark >> np.uint64(64 - MARK)).astype(np.int64)


class Hot:
    """Which anchors are hot: all whose both counters reach the bound; some others may be taken along."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.least = max(HOT_ROWS, 8 * int(counts[0].sum()) >> COUNTERS)

    def any(self) -> bool:
        return bool((self.counts >= self.least).any(axis=1).all())

    def among(self, seed: np.ndarray) -> np.ndarray:
        first, second = _slots(seed)
        return (self.counts[0, first] >= self.least) & (self.counts[1, second] >= self.least)


def _slots(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (seed >> np.uint64(64 - COUNTERS)).astype(np.int64), (mixed(seed) >> np.uint64(64 - COUNTERS)).astype(np.int64)


def _counted(length: int):
    """Arrow task: (doc_id, text) in, counts of different surroundings per anchor slot out."""
    def run(found):
        counts = np.zeros((2, 1 << COUNTERS), np.int64)
        for batch in slices(found):
            for _, data, begins in batches(batch.column("text").to_pylist(), BATCH_CHARS):
                _, seed, _, _, _, mark = anchors(data, begins, length)
                _, once = np.unique(mixed(seed ^ mark.view(np.uint64)), return_index=True)
                for row, slot in zip(counts, _slots(seed[once]), strict=True):
                    row += np.bincount(slot, minlength=1 << COUNTERS)
        parts = counts.reshape(PARTS, -1)
        if counts.any():
            yield pa.RecordBatch.from_pydict({"bucket": list(range(PARTS)), "payload": [_pack([p]) for p in parts]})
    return run


def _summed(found):
    """Arrow task: counts of equal slots added; sorted by bucket."""
    for bucket, payloads in _by_bucket(found):
        total = 0
        for p in payloads:
            total = total + np.frombuffer(p, np.int64)
        yield pa.RecordBatch.from_pydict({"bucket": [bucket], "payload": [_pack([total])]})


def _by_bucket(found) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Rows of each bucket in turn, unpacked one by one."""
    rows = ((key, payload) for batch in found
            for key, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload"), strict=True))
    for key, group in groupby(rows, key=lambda r: r[0]):
        yield key, (_unpack(payload) for _, payload in group)


def hot_anchors(rows: DataFrame, length: int) -> Hot | None:
    """The hot anchors of the texts, or None; the driver receives the counters."""
    packed = rows.mapInArrow(_counted(length), PACKED)
    counted = packed.repartition(PARTS, "bucket").sortWithinPartitions("bucket").mapInArrow(_summed, PACKED).toArrow()
    counts = np.zeros((PARTS, (2 << COUNTERS) // PARTS), np.int64)
    for bucket, payload in zip(counted["bucket"].to_pylist(), counted["payload"].to_pylist(), strict=True):
        counts[bucket] = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.int64)
    hot = Hot(counts.reshape(2, -1))
    return hot if hot.any() else None


WINDOWS = "window long, doc_id long, span long, gone boolean"


def _windows(length: int, hot: Broadcast):
    """Arrow task: strings of `length` bytes about hot anchors, each once per batch with its smallest document;
    those of larger documents in the batch are gone already."""
    def run(found):
        for batch in slices(found):
            ids = batch.column("doc_id").to_numpy()
            for first, data, begins in batches(batch.column("text").to_pylist(), BATCH_CHARS):
                at, seed, owner, left, right, _ = anchors(data, begins, length)
                here = np.flatnonzero(hot.value.among(seed))
                if not len(here):
                    continue
                step = np.arange(length - ANCHOR + 1)
                start = at[here][:, None] - step
                inside = (step <= left[here][:, None]) & (length - ANCHOR - step <= right[here][:, None])
                start = np.unique(start[inside])
                up, down = _power(len(data) + 1)
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])))
                window = mixed((sums[start + length] - sums[start]) * down[start]).view(np.int64)
                text = np.searchsorted(begins, start, "right") - 1
                doc, place = ids[first + text], start - begins[text]
                order = np.lexsort((place, doc, window))
                window, doc, place = window[order], doc[order], place[order]
                head = np.r_[True, window[1:] != window[:-1]]
                gone = doc > doc[np.maximum.accumulate(np.where(head, np.arange(len(doc)), 0))]
                yield pa.RecordBatch.from_pydict({"window": window, "doc_id": doc, "span": place << NOTE | length, "gone": gone})
    return run


def _hot_spans(rows: DataFrame, length: int, hot: Hot) -> DataFrame:
    """Spans about hot anchors that repeat in a smaller document."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)
    found = stored(rows.mapInArrow(_windows(length, shared), WINDOWS), "hot-windows")
    left = found.where("not gone")
    least = stored(left.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                   .where("most > least").select("window", "least"), "hot-least")
    later = left.join(least, "window").where("doc_id > least")
    return found.where("gone").select("doc_id", "span").unionByName(later.select("doc_id", "span"))


def _pack(columns: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _shape(length: int) -> np.dtype:
    reach = length - ANCHOR
    return np.dtype([("seed", "u8"), ("doc", "i8"), ("at", "i4"), ("left", "u1"), ("right", "u1"),
                     ("around", "u1", 2 * reach + ANCHOR)])


def _cuts(bucket: np.ndarray) -> list[tuple[int, int]]:
    ends = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)].tolist()
    return list(zip(ends[:-1], ends[1:], strict=True))


def _bucket(seed: np.ndarray, buckets: int) -> np.ndarray:
    return ((seed >> np.uint64(41)) % np.uint64(buckets)).astype(np.int64)


def _unpack(payload: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(payload.as_buffer())


def _low_bytes(values: np.ndarray, n: int) -> np.ndarray:
    return values.view(np.uint8).reshape(-1, 8)[:, :n]


def _from_low(raw: bytes, at: int, rows: int, n: int) -> np.ndarray:
    out = np.zeros((rows, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8, rows * n, at).reshape(rows, n)
    return out.view(np.int64).ravel()


def _digested(length: int, buckets: int, hot: Broadcast | None):
    """Arrow task: (doc_id, text) in, packed digests of anchors out; marks decided here go to bucket -1."""
    def run(found):
        for batch in slices(found):
            ids, text = batch.column("doc_id").to_numpy(), batch.column("text").to_pylist()
            for first, data, begins in batches(text, BATCH_CHARS):
                _, seed, owner, _, _, mark = anchors(data, begins, length)
                if hot and len(seed):
                    cold = ~hot.value.among(seed)
                    seed, owner, mark = seed[cold], owner[cold], mark[cold]
                if not len(seed):
                    continue
                doc, bucket = ids[first + owner], _bucket(seed, buckets)
                least, order = _least_docs(seed, mark, doc)
                gone = doc[order] > least
                out = [(-1 - int(first), _pack([doc[order][gone], mark[order][gone] << 1]))] if gone.any() else []
                order = order[~gone]
                order = order[np.lexsort((doc[order], bucket[order]))]
                for a, b in _cuts(bucket[order]):
                    at = order[a:b]
                    out.append((int(bucket[at[0]]), _pack([doc[at], _low_bytes(seed[at].view(np.int64), 5),
                                                           _low_bytes(mark[at], 6)])))
                yield pa.RecordBatch.from_pydict({"bucket": [o[0] for o in out], "payload": [o[1] for o in out]})
    return run


def _least_docs(seed: np.ndarray, mark: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest document with a row's anchor and surroundings, order of the rows): sorted by both."""
    order = np.lexsort((doc, mark, seed))
    s, m = seed[order], mark[order]
    head = np.r_[True, (s[1:] != s[:-1]) | (m[1:] != m[:-1])]
    return doc[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))], order


def _marked():
    """Arrow task: packed digests sorted by bucket in, marks out."""
    shape = arrow_shape(MARKS)

    def of(doc: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(mark, pa.int64())], schema=shape)

    def decided(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, seed, mark = (np.concatenate(c) for c in zip(*held, strict=True))
        least, order = _least_docs(seed, mark, doc)
        doc, seed, mark = doc[order], seed[order], mark[order]
        gone = doc > least
        starts = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]])
        sizes = np.diff(np.r_[starts, len(seed)])
        several = np.maximum.reduceat(least, starts) > np.minimum.reduceat(least, starts)
        asked = np.repeat(several, sizes) & ~gone
        return of(np.r_[doc[gone], doc[asked]], np.r_[mark[gone] << 1, mark[asked] << 1 | 1])

    def run(found):
        held, bucket = [], None
        for batch in found:
            for key, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload"), strict=True):
                raw = _unpack(payload)
                if key < 0:
                    yield of(*np.split(np.frombuffer(raw, np.int64), 2))
                    continue
                if key != bucket and held:
                    yield decided(held)
                    held = []
                bucket, n = key, len(raw) // 19
                held.append((np.frombuffer(raw, np.int64, n), _from_low(raw, 8 * n, n, 5), _from_low(raw, 13 * n, n, 6)))
        if held:
            yield decided(held)
    return run


def _packed(length: int, buckets: int):
    """Arrow task: (doc_id, text, marks) in, packed anchors with their bytes out; spans that go are in bucket -1."""
    shape, reach = _shape(length), length - ANCHOR

    def run(found):
        for batch in slices(found):
            ids, text = batch.column("doc_id").to_numpy(), batch.column("text").to_pylist()
            marks = batch.column("marks").to_pylist()
            for first, data, begins in batches(text, BATCH_CHARS):
                at, seed, owner, left, right, mark = anchors(data, begins, length)
                if not len(at):
                    continue
                wanted = np.unique(np.concatenate([(np.array(m, np.int64) | k << MARK + 1)
                                                   for k, m in enumerate(marks[first:first + len(begins) - 1])]))
                own = owner << MARK + 1 | mark << 1
                gone, asked = np.isin(own, wanted), np.isin(own | 1, wanted)
                out = []
                if gone.any():
                    spans = (at - begins[owner] - left)[gone] << NOTE | (left + ANCHOR + right)[gone]
                    out.append((-1 - int(first), _pack([ids[first + owner[gone]], spans])))
                at, bucket = at[asked], _bucket(seed[asked], buckets)
                rows = np.zeros(len(at), shape)
                rows["seed"], rows["doc"], rows["at"] = seed[asked], ids[first + owner[asked]], at - begins[owner[asked]]
                rows["left"], rows["right"] = left[asked], right[asked]
                wide = np.concatenate((np.zeros(reach, np.uint8), data, np.zeros(reach, np.uint8)))
                rows["around"] = np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + ANCHOR)[at]
                _blank(rows, reach)
                order = np.argsort(bucket, kind="stable")
                rows, bucket = rows[order], bucket[order]
                out += [(int(bucket[a]), _pack([rows[f][a:b] for f in shape.names])) for a, b in _cuts(bucket)
                        if b > a]
                if out:
                    yield pa.RecordBatch.from_pydict({"bucket": [o[0] for o in out], "payload": [o[1] for o in out]})
    return run


def _blank(rows: np.ndarray, reach: int) -> None:
    """Zero bytes that lie outside the text."""
    for side, count in (("left", 0), ("right", 1)):
        for k in np.flatnonzero(rows[side] < reach):
            have = int(rows[side][k])
            if count:
                rows["around"][k, reach + ANCHOR + have:] = 0
            else:
                rows["around"][k, :reach - have] = 0


def _spans(rows: np.ndarray) -> list[np.ndarray]:
    """Document and packed span of all that surrounds the anchors."""
    start = rows["at"].astype(np.int64) - rows["left"]
    return [rows["doc"].copy(), start << NOTE | (rows["left"].astype(np.int64) + ANCHOR + rows["right"])]


def first_of_class(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rows sorted by seed and surroundings, those of the smallest document only; where a class of equal
    surroundings starts; and the spans of rows of larger documents: all of their surroundings repeats."""
    width = rows.dtype["around"].shape[0]
    mix = np.zeros((len(rows), -(-(width + 2) // 8) * 8), np.uint8)
    mix[:, :width], mix[:, width], mix[:, width + 1] = rows["around"], rows["left"], rows["right"]
    words = mix.view(np.uint64)
    key = np.zeros(len(rows), np.uint64)
    for k in range(words.shape[1]):
        key = mixed((key ^ words[:, k]) * np.uint64(2 * k + 0x9E3779B97F4A7C15 | 1))
    order = np.lexsort((rows["doc"], key, rows["seed"]))
    rows, key, words = rows[order], key[order], words[order]
    same = (key[1:] == key[:-1]) & (rows["seed"][1:] == rows["seed"][:-1])
    same &= (words[1:] == words[:-1]).all(axis=1)
    head = np.r_[True, ~same]
    least = rows["doc"][np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))]
    first = rows["doc"] == least
    return rows[first], np.flatnonzero(head[first]), _spans(rows[~first])


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    differ = x != y
    return np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(common length, first row, last row) of each interval of the prefix tree with at least `least`.

    `lcp[i]` belongs to sorted rows i and i + 1. A stack holds the open intervals.
    """
    stack: list[tuple[int, int]] = []
    for i, here in enumerate([*lcp, -1]):
        start = i
        while stack and stack[-1][0] > here:
            size, start = stack.pop()
            if size >= least:
                yield size, start, i
        if here >= 0 and (not stack or stack[-1][0] < here):
            stack.append((here, start))


def maximal_repeats(before: np.ndarray, after: np.ndarray, least: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes to the left, bytes to the right, rows) of each maximal repeat around a common anchor.

    `before` holds what precedes the anchor, read backwards; `after` what follows it.
    Only repeats of at least `least` bytes beside the anchor count.
    """
    order = np.lexsort(after.T[::-1])
    lcp = common(after[order[1:]], after[order[:-1]]).tolist()
    for size, a, b in intervals(lcp, max(0, least - before.shape[1])):
        rows = order[a:b + 1]
        rows = rows[np.lexsort(before[rows].T[::-1])]
        back = common(before[rows[1:]], before[rows[:-1]]).tolist()
        for depth, c, d in intervals(back, least - size):
            yield depth, size, rows[c:d + 1]


def repeated(rows: np.ndarray, length: int) -> Iterator[list[np.ndarray]]:
    """Spans of a bucket's anchors that repeat in a smaller document."""
    reach = length - ANCHOR
    every, heads, spans = first_of_class(rows)
    yield spans
    rows, counts = every[heads], np.diff(np.r_[heads, len(every)])

    def placed(classes: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        """Spans of all rows of the given classes."""
        n = counts[classes]
        at = np.repeat(heads[classes] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        left, right = np.repeat(left, n), np.repeat(right, n)
        return [every["doc"][at], every["at"][at].astype(np.int64) - left << NOTE | left + ANCHOR + right]

    starts = np.flatnonzero(np.r_[True, rows["seed"][1:] != rows["seed"][:-1]])
    sizes = np.diff(np.r_[starts, len(rows)])
    # ends of texts differ from all bytes and from each other's: 256 on one side, by row on the other
    def sides(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.arange(reach)
        back = part["around"][:, :reach][:, ::-1].astype(np.int16)
        ahead = part["around"][:, reach + ANCHOR:].astype(np.int16)
        own = -1 - np.arange(len(part), dtype=np.int64)[:, None]
        return (np.where(place < part["left"][:, None], back, own), np.where(place < part["right"][:, None], ahead, own))

    two = starts[sizes == 2]
    if len(two):
        pair = rows[np.stack((two, two + 1), axis=1).ravel()]
        back, ahead = sides(pair)
        left, right = common(back[::2], back[1::2]), common(ahead[::2], ahead[1::2])
        x, y = pair[::2], pair[1::2]
        hit = (left + right >= reach) & (x["doc"] != y["doc"])
        later = np.where(x["doc"] > y["doc"], two, two + 1)
        yield placed(later[hit], left[hit].astype(np.int64), right[hit].astype(np.int64))
    found: list[tuple[np.ndarray, int, int]] = []
    for g in np.flatnonzero(sizes > 2):
        part = rows[starts[g]:starts[g] + sizes[g]]
        if part["doc"].max() == part["doc"].min():
            continue
        back, ahead = sides(part)
        doc = part["doc"]
        for left, right, members in maximal_repeats(back, ahead, reach):
            found.append((starts[g] + members[doc[members] > doc[members].min()], left, right))
    if found:
        n = [len(f[0]) for f in found]
        yield placed(np.concatenate([f[0] for f in found]), np.repeat([f[1] for f in found], n),
                     np.repeat([f[2] for f in found], n))


def _found(length: int):
    """Arrow task: packed anchors sorted by bucket in, spans out."""
    shape = _shape(length)
    result = arrow_shape(SPANS)

    def unpacked(raw: bytes) -> np.ndarray:
        rows, at = np.zeros(len(raw) // shape.itemsize, shape), 0
        for name in shape.names:
            kind = shape[name]
            size = kind.itemsize * len(rows)
            rows[name] = np.frombuffer(raw, kind.base, size // kind.base.itemsize, at).reshape(rows[name].shape)
            at += size
        return rows

    def run(found):
        held, bucket = [], None
        for batch in found:
            for key, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload"), strict=True):
                raw = _unpack(payload)
                if key < 0:
                    yield batch_of(np.split(np.frombuffer(raw, np.int64), 2))
                    continue
                if key != bucket and held:
                    yield from map(batch_of, repeated(np.concatenate(held), length))
                    held = []
                bucket = key
                held.append(unpacked(raw))
        if held:
            yield from map(batch_of, repeated(np.concatenate(held), length))

    def batch_of(spans: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(spans[0], pa.int64()), pa.array(spans[1], pa.int64())],
                                          schema=result)
    return run


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, span): stretches of at least `length` bytes that also occur in a smaller document.

    A span is start << NOTE | bytes. Together they cover every byte of every string of
    `length` bytes that starts in a smaller document too; they overlap.
    """
    rows = texts(docs).where("doc_id is not null")
    return _repeated_spans(rows, length)


def _repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))

    def gathered(packed: DataFrame) -> DataFrame:
        return packed.repartition("bucket").sortWithinPartitions("bucket")
    hot = hot_anchors(rows, length)
    known = rows.sparkSession.sparkContext.broadcast(hot) if hot else None
    marks = gathered(rows.mapInArrow(_digested(length, buckets, known), PACKED)).mapInArrow(_marked(), MARKS)
    marks = stored(marks.groupBy("doc_id").agg(F.collect_set("mark").alias("marks")), "anchor-marks")
    packed = rows.join(marks.hint("shuffle_hash"), "doc_id").mapInArrow(_packed(length, buckets), PACKED)
    spans = gathered(packed).mapInArrow(_found(length), SPANS)
    return spans.unionByName(_hot_spans(rows, length, hot)) if hot else spans


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row.

    A null text counts as empty. A row without doc_id loses nothing. Rows that share a
    doc_id are one document; neither is the smaller. Other columns are ignored. The text
    is shuffled once: both joins by doc_id share the exchange.
    """
    rows = texts(docs)
    named = rows.where("doc_id is not null")
    spans = _repeated_spans(named, length).groupBy("doc_id").agg(F.collect_set("span").alias("spans"))
    joined = named.join(spans.hint("shuffle_hash"), "doc_id", "left") \
        .unionByName(rows.where("doc_id is null").withColumn("spans", F.lit(None).cast("array<long>")))

    def work(doc_id, text, spans):
        out: dict[str, list] = {"doc_id": doc_id, "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for t, s in zip(text, spans, strict=True):
            data = t.encode("utf-8", "surrogatepass")
            runs = merged(s or [])
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            out["n_bytes"].append(len(data))
            out["n_removed"].append(sum(b - a for a, b in runs))
            out["n_spans"].append(len(runs))
            out["kept_sha256"].append(kept.hexdigest())
        return out
    return map_batches(joined, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", work)


def merged(spans: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of packed spans; adjacent ones join."""
    if not spans:
        return []
    s = np.sort(np.array(spans, np.int64))
    starts = s >> NOTE
    ends = np.maximum.accumulate(starts + (s & (1 << NOTE) - 1))
    head = np.r_[True, starts[1:] > ends[:-1]]
    return list(zip(starts[head].tolist(), ends[np.r_[head[1:], True]].tolist(), strict=True))
