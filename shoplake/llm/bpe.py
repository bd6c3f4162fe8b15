"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols. Leaf i of its tree holds the merge rank of the pair that
starts at symbol i, joined with i, so the root is the leftmost pair of lowest rank. A
merge changes three leaves (the pair itself, the one before, the one that vanishes)
and their log2(n) ancestors; it ends when the root is infinite. Trees of equally
long words are updated side by side as numpy columns.

Words repeat, so each task keeps a bounded memo of words and of white-space-free chunks. Text never crosses tasks: one narrow scan, no shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame

from shoplake.llm.shared import map_batches, runs, texts

MEMO_WORDS = 120_000            # words, and as many chunks, that one task remembers: some 70 MB
MEMO_CHARS = 64                 # longer ones are not remembered
TILE_CHARS = 1 << 21            # characters of text whose new words are merged together
TILE = 1 << 18                  # symbols that are merged side by side
_NEVER = np.int64(1) << 62
_SPACE = "\t-\r \x85\xa0  -     　"
_SPLIT = re.compile(f"[{_SPACE}]+")
Coded = tuple[str, int, str]    # ids joined by spaces, their number, decoded text
_CONTROL = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a word-end BPE vocabulary file (lower case, NFC, white space dropped)."""

    _piece = regex.compile(r"'(?:[stmd]|re|ve|ll)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self._bytes = byte_alphabet()
        self._first = np.array([self.vocab[c] for c in self._bytes])
        self._last = np.array([self.vocab[c + self.suffix] for c in self._bytes])
        base = max(self.vocab.values()) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([self.vocab[a] * base + self.vocab[b] for a, b in merges])
        made = np.array([self.vocab[a + b] for a, b in merges])
        order = np.argsort(pairs, kind="stable")
        self._base, self._pairs, self._ranks, self._made = base, pairs[order], order, made[order]
        self._cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self._memo: dict[str, Coded] = {}
        self._words: dict[str, Coded] = {}
        self.forget()

    def forget(self) -> None:
        """Empty the memos; a task does so at its end, since its worker goes on to other work."""
        self._memo.clear()
        self._words = {s: (str(i), 1, s) for s, i in self.special.items()}

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or never) and merged symbol of each pair."""
        key = left * self._base + right
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        hit = self._pairs[at] == key
        return np.where(hit, self._ranks[at], _NEVER), self._made[at]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (not empty)."""
        out: list[list[int]] = [[] for _ in words]
        sized: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            sized.setdefault(max(1, (len(w) - 1).bit_length()), []).append(i)
        for bits, rows in sized.items():
            step = max(1, TILE >> bits)
            for start in range(0, len(rows), step):
                part = rows[start:start + step]
                flat, ends = self._merge_tile([words[i] for i in part], 1 << bits)
                begin = 0
                for i, end in zip(part, ends, strict=True):
                    out[i] = flat[begin:end]
                    begin = end
        return out

    def _merge_tile(self, words: list[bytes], width: int) -> tuple[list[int], list[int]]:
        """All ids in a row, and where each word ends."""
        n, row = len(words), np.arange(len(words))
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = self._first[raw]
        ids[row, sizes - 1] = self._last[raw[row, sizes - 1]]
        place = np.arange(width)
        after = np.broadcast_to(place + 1, (n, width)).copy()     # next living symbol; `sizes` ends the word
        before = np.broadcast_to(place - 1, (n, width)).copy()
        alive = place < sizes[:, None]
        tree = np.full((n, 2 * width), _NEVER)
        rank, _ = self._pair(ids[:, :-1], ids[:, 1:])
        rank = np.where(alive[:, 1:] & (rank < _NEVER), rank * width + place[:-1], _NEVER)
        tree[:, width:2 * width - 1] = rank
        level = width
        while level > 1:
            level //= 2
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])

        def put(r: np.ndarray, leaf: np.ndarray, value: np.ndarray | np.int64) -> None:
            at = leaf + width
            tree[r, at] = value
            while at.size and at[0] > 1:
                at = at >> 1
                tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])

        while True:
            row = row[tree[row, 1] < _NEVER]
            if not row.size:
                break
            at = tree[row, 1] % width
            gone = after[row, at]
            _, made = self._pair(ids[row, at], ids[row, gone])
            ids[row, at] = made
            alive[row, gone] = False
            follow = after[row, gone]
            after[row, at] = follow
            more = follow < sizes[row]
            before[row[more], follow[more]] = at[more]
            put(row, gone, _NEVER)
            value = np.full(row.size, _NEVER)
            rank, _ = self._pair(made[more], ids[row[more], follow[more]])
            value[more] = np.where(rank < _NEVER, rank * width + at[more], _NEVER)
            put(row, at, value)
            back = before[row, at]
            led = back >= 0
            r, b = row[led], back[led]
            rank, _ = self._pair(ids[r, b], made[led])
            put(r, b, np.where(rank < _NEVER, rank * width + b, _NEVER))
        return ids[alive].tolist(), np.cumsum(alive.sum(1)).tolist()

    def _pieces(self, chunk: str) -> list[str]:
        """Words and special tokens of a chunk without white space."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if "<" not in chunk:
                return self._piece.findall(chunk.lower())
        out = []
        for k, part in enumerate(self._cut.split(chunk)):
            if k % 2:
                out.append(part)
            elif part:
                part = unicodedata.normalize("NFC", part)
                part = part.replace("Σ", "σ").lower()      # letter by letter: no final-sigma rule
                out.extend(self._piece.findall(part))
        return out

    def _learn(self, chunks: list[str]) -> dict[str, Coded]:
        """Each chunk's coding, from those of its words; new words are merged all at once."""
        parts = [self._pieces(c) for c in chunks]
        words = self._words
        fresh = list({w for ps in parts for w in ps if w not in words})
        shown, ids = self.tokens, self.merge([w.encode() for w in fresh])
        coded = {w: (" ".join([str(i) for i in got]), len(got), " ".join([shown[i] for i in got]))
                 for w, got in zip(fresh, ids, strict=True)}
        out = {}
        for c, ps in zip(chunks, parts, strict=True):
            got = [words.get(w) or coded[w] for w in ps]
            out[c] = got[0] if len(got) == 1 else (
                " ".join([g[0] for g in got]), sum([g[1] for g in got]), " ".join([g[2] for g in got]))
        room = MEMO_WORDS - len(words)
        if room > 0:
            words.update((w, v) for w, v in list(coded.items())[:room] if len(w) <= MEMO_CHARS)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary file names no decoder: token strings joined by one space."""
        return " ".join(self.tokens[i] for i in ids)

    def encode_all(self, many: list[str]) -> list[Coded]:
        """(ids joined by spaces, their number, decoded text) of each text."""
        chunks = [_SPLIT.split(t) if _CONTROL.search(t) else t.split() for t in many]
        memo = self._memo
        fresh = self._learn(list({c for cs in chunks for c in cs if c and c not in memo}))
        out = []
        for cs in chunks:
            got = [memo.get(c) or fresh[c] for c in cs if c]
            out.append((" ".join([g[0] for g in got if g[1]]), sum([g[1] for g in got]),
                        " ".join([g[2] for g in got if g[1]])))
        room = MEMO_WORDS - len(memo)
        if room > 0:
            memo.update((c, v) for c, v in list(fresh.items())[:room] if len(c) <= MEMO_CHARS)
        return out


_loaded: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """One encoder per worker and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of each row's whole text.

    A null or empty text has no ids and decodes to an empty text; equal rows stay; other
    columns are ignored. Special-token strings in a text become those tokens.
    """
    def work(doc_id, text):
        got = encoder(vocabulary).encode_all(text)
        return {"doc_id": doc_id, "ids": [[int(i) for i in g[0].split()] for g in got], "decoded": [g[2] for g in got]}
    return map_batches(texts(docs), "doc_id long, ids array<int>, decoded string", work,
                       lambda: encoder(vocabulary).forget())


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as `encode_documents`, digested where the text lies."""
    def sha(s: str) -> str:
        return hashlib.sha256(s.encode()).hexdigest()

    def work(doc_id, text):
        out: dict[str, list] = {"doc_id": doc_id, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for part in runs(text, TILE_CHARS):
            for ids, n, decoded in encoder(vocabulary).encode_all(part):
                out["n_tokens"].append(n)
                out["ids_sha256"].append(sha(ids))
                out["decoded_sha256"].append(sha(decoded))
        return out
    return map_batches(texts(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work,
                       lambda: encoder(vocabulary).forget())
