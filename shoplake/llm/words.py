"""Word and byte n-gram hashes of many texts at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BATCH_CHARS = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE^i and its inverse modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Bytes that belong to a word: ASCII letters and digits, and all of a character beyond ASCII.
WORD_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Bytes that are not ASCII white space.
SOLID_BYTES = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])


#: Characters of scripts without spaces between words: Thai, Lao, Tibetan; Myanmar; Khmer; Han, kana, Yi; more Han.
UNSPACED = ((0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029),
            (0x3031, 0x3035), (0x3040, 0x30FA), (0x30FC, 0x312F), (0x3190, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
            (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))
#: Punctuation and spaces beyond ASCII of three bytes; Thai to Khmer stops among them.
STOPS = ((0xE2F, 0xE2F), (0xE5A, 0xE5B), (0xF08, 0xF14), (0x104A, 0x104F), (0x17D4, 0x17DA), (0x2000, 0x200B),
         (0x2010, 0x2029), (0x202F, 0x205F), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x303D, 0x303F),
         (0x30FB, 0x30FB), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, code point) of the characters of three and four bytes in UTF-8 data."""
    at = np.flatnonzero(data >= 0xE0)
    b = [data[np.minimum(at + k, len(data) - 1)].astype(np.int64) for k in range(4)]
    three = (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63
    return at, np.where(b[0] < 0xF0, three, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63)


def _among(points: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    k = np.searchsorted([a for a, _ in ranges], points, "right") - 1
    return (k >= 0) & (points <= np.array([b for _, b in ranges])[k])


def word_hashes(data: np.ndarray, member: np.ndarray, unspaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word in `data`, its 64-bit hash); words are maximal runs of `member` bytes.

    If `unspaced`, a character of a script without spaces is a word, and STOPS end words.
    """
    inside = np.concatenate(([False], member[data], [False]))
    edge = inside[1:] != inside[:-1]
    if unspaced and (data >= 0xE0).any():
        at, points = _characters(data)
        stop, alone = _among(points, STOPS), _among(points, UNSPACED)
        alone &= ~stop
        size = 3 + (data[at] >= 0xF0)
        for k in range(3):
            inside[1 + at[stop] + k] = False
        edge = inside[1:] != inside[:-1]
        cut = np.zeros(len(data) + 1, bool)
        cut[at[alone]] = cut[(at + size)[alone]] = True
        starts = np.flatnonzero(inside[1:] & (edge | cut))
        ends = np.flatnonzero(inside[:-1] & (edge | cut))
    else:
        flips = np.flatnonzero(edge)
        starts, ends = flips[::2], flips[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    up, down = _power(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)))
    return starts, mixed((sums[ends] - sums[starts]) * down[starts])


def batches(texts: list[str], chars: int = BATCH_CHARS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes of some texts with a line feed after each, where each begins)."""
    first, part, size = 0, [], 0
    for i, t in enumerate(texts):
        if part and size + len(t) > chars:
            yield first, *_joined(part)
            first, part, size = i, [], 0
        part.append(t.encode("utf-8", "surrogatepass"))
        size += len(t)
    if part:
        yield first, *_joined(part)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    begins = np.cumsum([0, *[len(p) + 1 for p in parts]])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), begins
