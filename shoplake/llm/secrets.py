"""Secret scans: keyword automaton, anchored patterns near its hits, checksum validation.

An Aho-Corasick automaton over all keywords passes each text once; a pattern is only
tried at a hit. Runs of hex digits have no keyword and are found by their length.
Tokens that embed a checksum are reported only if it holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache as once

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplake.llm.shared import map_batches, texts

# fixed values: public formats of secrets
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"""
                    r"""[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_HEX = 24
HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)
GITHUB = re.compile(r"gh[opsur]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign",
            "api_key": "assign", "akia": "access", "gho_": "github", "ghp_": "github", "ghs_": "github",
            "ghu_": "github", "ghr_": "github", "npm_": "npm"}
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = ("assign", "access", "hex")
LEAST_VALUE, LEAST_ACCESS = 6, 20

Span = tuple[int, int, int]     # start, place of its kind in KINDS, end; code points, end exclusive


@once
def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        machine.add_word(word, (len(word), kind))
    machine.make_automaton()
    return machine


#: What a byte of UTF-8 is to a hex run: "x" if one of its digits, else a space.
_HEX_MARKS = bytes(ord("x") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))
_HEX_RUN = b"x" * LEAST_HEX


def checksum62(body: str) -> str:
    """CRC-32 of the body in six base-62 digits, as in tokens that end in their checksum."""
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits


def _accepted(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= LEAST_VALUE
    if kind == "access":
        return m.end() - m.start() >= LEAST_ACCESS
    return checksum62(m[1]) == m[2]


PATTERNS = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}


def find_secrets(text: str) -> list[Span]:
    """Spans sorted by start, then kind; per kind leftmost and not overlapping.

    On bytes, lower-casing touches A-Z only and so keeps every character in its place, and a search
    for the marks of a whole run tells whether the text has one: both are far faster than per character.
    """
    data = text.encode("utf-8", "surrogatepass")
    spans = []
    if _HEX_RUN in data.translate(_HEX_MARKS):
        spans = [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    lowered = data.lower().decode("utf-8", "surrogatepass")
    free = dict.fromkeys(KINDS, 0)
    for last, (size, kind) in _automaton().iter(lowered):
        start = last - size + 1
        if start < free[kind]:
            continue
        m = PATTERNS[kind].match(text, start)
        if m:
            free[kind] = m.end()
            if _accepted(kind, m):
                spans.append((start, KINDS.index(kind), m.end()))
    return sorted(spans)


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every covered stretch replaced by `[kind]` of its first span."""
    out, at = [], 0
    for start, k, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[k]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row's whole text.

    A null or empty text has no spans (and the digest of an empty list); equal rows
    stay; other columns are ignored.
    """
    def work(doc_id, text):
        out: dict[str, list] = {"doc_id": doc_id} | {c: [] for c in
                                                     ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for t in text:
            spans = find_secrets(t)
            for k, kind in enumerate(BASE):
                out[f"n_{kind}"].append(sum(s[1] == k for s in spans))
            out["base_sha256"].append(hashlib.sha256(shown([s for s in spans if s[1] < len(BASE)]).encode())
                                      .hexdigest())
            out["spans"].append(shown(spans))
        return out
    return map_batches(texts(docs), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
                                    "spans string", work)


def redact_documents(docs: DataFrame) -> DataFrame:
    """`docs` with secrets in `text` replaced by `[kind]`; `n_chars` follows where it is a column.

    Every row stays, equal rows alike; a null text stays null and an empty one empty; an empty
    table stays empty. The whole text is scanned, however long. Columns other than text and
    n_chars pass through, whatever their names.
    """
    names, schema = docs.columns, docs.schema

    def work(**columns):
        columns["text"] = [None if t is None else redacted(t, find_secrets(t)) for t in columns["text"]]
        return columns
    out = map_batches(docs, schema, work)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))
    return out
