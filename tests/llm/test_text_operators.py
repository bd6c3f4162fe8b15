"""Text operators against plain versions on small frames with nulls, empty and long texts, ties, repeats and
columns whose names clash with inner ones."""

import hashlib
import re
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from shoplake.llm import (
    bpe, components, decontaminate, kd_shards, pivots, quality, secrets, simhash, suffix_repeats, token_counts, url_trust)

WORDS = "the and of red green house runs Fast über naïve 42 cats sing low blue tree".split()
DOCS = "doc_id long, text string, seed string, words string, key int, span string, left string"


def phrase(n, seed):
    dice = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(dice.integers(30)) for i in dice.integers(0, len(WORDS), n))


def frame(spark, texts, first=0):
    return spark.createDataFrame([(None if t == "NOID" else first + i, t, "s", "w", 1, "x", "y")
                                  for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def texts():
    long = phrase(4000, 1)
    shared = phrase(40, 2)
    return [None, "", " \n\t", "a", shared, phrase(30, 3) + " " + shared + " " + phrase(20, 4), long, long,
            "Don't  stop!!\nWe'll <|endoftext|> é é ß", shared, phrase(60, 5), "x" * 3000, None, "日本語 テキスト 😀",
            phrase(60, 5).replace("red", "blue", 1)]


def table(df, key="doc_id"):
    rows = df.collect()
    return {r[key]: r for r in rows}


def test_bpe_equals_the_library(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = table(bpe.encode_documents(frame(spark, texts), path))
    digests = table(bpe.encode_digests(frame(spark, texts), path))
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        assert got[i]["ids"] == ids and got[i]["decoded"] == shown
        assert digests[i]["n_tokens"] == len(ids)
        assert digests[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
    assert bpe.encode_documents(frame(spark, []), path).count() == 0


def test_token_counts_fill_and_use_the_cache(spark, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    cache = token_counts.new_cache(spark)
    got = table(token_counts.count_tokens(frame(spark, texts), path, cache))
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(library.encode(t or "")) and got[i]["n_bytes"] == len((t or "").encode())
    distinct = len({t or "" for t in texts})
    assert spark.read.parquet(cache).count() == distinct
    token_counts.count_tokens(frame(spark, [*texts, "new one"]), path, cache).count()
    assert spark.read.parquet(cache).count() == distinct + 1
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0


def test_secrets_equal_plain_patterns(spark):
    token = "ghp_" + "A" * 30
    good = token + secrets.checksum62("A" * 30)
    many = [None, "", 'Password = "abc123!" token:short apikey=ABCDEF', "AKIA" + "Z" * 16 + " AKIAxx", "f" * 24 + " " + "f" * 23,
            good + " " + token + "AAAAAA", "ſecret=abcdef secret=abcdef", "é😀 passwd:  'longvalue' " * 200, "passwordtoken=abcdefg"]
    assign = re.compile(r'''(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', re.I | re.A)
    got = table(secrets.scan_documents(frame(spark, many)))
    for i, t in enumerate(many):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        shown = secrets.shown(sorted(want))
        assert got[i]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest(), t
        assert got[i]["n_assign"] == sum(k == 0 for _, k, _ in want)
    assert got[5]["spans"] == f"github:0:{len(good)}"
    cleaned = table(secrets.redact_documents(frame(spark, many)))
    assert cleaned[0]["text"] is None and "abc123" not in cleaned[2]["text"] and cleaned[2]["seed"] == "s"


class Whole(str):
    """A text whose characters are not to be mapped one by one."""
    def translate(self, *_):
        raise AssertionError("mapped character by character")


class HexTries:
    """The pattern of hex runs, and the texts it was tried on."""
    def __init__(self):
        self.texts = []

    def finditer(self, text):
        self.texts.append(text)
        return re.finditer("[0-9a-f]{24,}", text)


def test_secrets_try_slow_steps_only_where_needed(monkeypatch):
    """Beyond ASCII too; letters whose lower case is ASCII or of another length stay as they are."""
    odd = ["é Password = abcdef", "to\u212aen=abcdef İİ ToKeN=abcdef", "ſecret=abcdef", "é" + "0f" * 11 + "a", "😀" + "0f" * 12 + "G",
           "a" * 23 + "é" + "b" * 23, "\ud800 Secret: abcdef", "f" * 30 + " " + "F" * 30]
    monkeypatch.setattr(secrets, "HEX", tries := HexTries())
    got = [secrets.find_secrets(Whole(t)) for t in odd]
    assert got == [[(2, 0, 19)], [(16, 0, 28)], [], [], [(1, 2, 25)], [], [(2, 0, 16)], [(0, 2, 30)]]
    assert tries.texts == [odd[4], odd[7]]


def simhash_plain(text, words):
    parts = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(parts[i:i + words]), 42) for i in range(max(1, len(parts) - words + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if parts else 0


def roots(ids, links):
    label = {i: i for i in ids}
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return label


def test_simhash_components_equal_all_pairs(spark, texts):
    many = [*texts, *[phrase(60, 5) + f" {k}" for k in range(12)]]
    got = table(simhash.simhash_components(frame(spark, many), words=4, radius=4))
    prints = [simhash_plain(t, 4) for t in many]
    near = [(a, b) for a, b in combinations(range(len(many)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = roots(range(len(many)), near)
    for i in range(len(many)):
        assert got[i]["fingerprint"] % 2 ** 64 == prints[i] and got[i]["component_id"] == want[i]
    assert simhash.simhash_components(frame(spark, []), 4, 4).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 4, 9])
def test_bit_sliced_distances(radius):
    dice = np.random.default_rng(radius)
    prints = dice.integers(0, 2 ** 63, (130, 2), dtype=np.uint64)
    prints[60:] = prints[:70]
    for k in range(60, 130):
        for bit in dice.integers(0, 63, 6):
            prints[k, bit % 2] ^= np.uint64(1) << np.uint64(bit)
    far = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    assert (simhash.near_lanes(prints, simhash.planes_of(prints), 130, radius) == (far <= radius)).all()
    assert (simhash.near_pairs(prints[:70], prints[60:], radius) == (far[np.arange(70), np.arange(60, 130)] <= radius)).all()


def test_blocks_of_a_busy_band_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 5)
    many = [phrase(200, 9) + f" {k}" for k in range(40)]
    got = simhash.simhash_components(frame(spark, many), words=4, radius=4).collect()
    prints = [simhash_plain(t, 4) for t in many]
    near = [(a, b) for a, b in combinations(range(40), 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = roots(range(40), near)
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_keep_first_drops_copies_only(spark, texts):
    base = phrase(300, 20)
    near = base.replace(base.split()[150], "changed", 1)
    many = [*texts, base, near, base, phrase(300, 21), "NOID"]
    got = simhash.keep_first(frame(spark, many))
    assert got.columns == frame(spark, many).columns
    n = len(texts)
    kept = [r["doc_id"] for r in got.collect()]
    assert n in kept and n + 1 not in kept and n + 2 not in kept and n + 3 in kept and None in kept
    assert 7 not in kept and 9 not in kept and 10 in kept


@pytest.mark.parametrize("block", [4096, 7])
def test_similar_documents_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    dice, many = np.random.default_rng(7), []
    for g, changed in enumerate([0, 1, 2, 3, 4, 6, 9]):          # groups from copies to texts far apart
        base = phrase(120, 50 + g).split()
        for _ in range(14):
            new = list(base)
            for at in dice.integers(0, len(base), changed):
                new[at] = f"new{dice.integers(10**6)}"
            many.append(" ".join(new))
    many += [None, "", " ", "two words", "two  words", "Two words"]
    sets = [set(simhash.shingle_hashes(t or "", 5).tolist()) for t in many]
    ties = [(i, j) for i, j in combinations(range(len(many)), 2)
            if (many[i] or "") == (many[j] or "") or len(sets[i] & sets[j]) >= max(1, 0.8 * len(sets[i] | sets[j]))]
    expected = roots(range(len(many)), ties)
    got = table(simhash.similar_documents(frame(spark, many)))
    assert {i: got[i]["component_id"] for i in got} == expected
    assert len(set(expected.values())) > 20


def test_repeated_lines_and_short_texts_equal_all_pairs(spark):
    many = []
    for k, times in enumerate([1, 10, 20, 40]):                  # a line that one of two long texts repeats
        base, line = phrase(1000, 200 + k), phrase(18, 300 + k)
        many += [base, base + f" {line}" * times]
    for k in range(80):                                          # 9 words and the first 8 of them
        short = phrase(9, 400 + k).split()
        many += [" ".join(short), " ".join(short[:8])]
    for n in range(4, 16):                                       # n shingles, without the last word, or one more changed
        for k in range(4):
            short = phrase(n + 4, 1000 + 10 * n + k).split()
            many += [" ".join(short), " ".join(short[:-1]), " ".join([*short[:-2], "end"])]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in many]
    ties = [(i, j) for i, j in combinations(range(len(many)), 2)
            if len(sets[i] & sets[j]) >= max(1, 0.8 * len(sets[i] | sets[j]))]
    got = table(simhash.similar_documents(frame(spark, many)))
    assert len(ties) > 130
    assert {i: got[i]["component_id"] for i in got} == roots(range(len(many)), ties)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (7, 6), (6, 5), (5, 4), (4, 3), (None, 2)] + [(20 + i, 21 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(set(got), [(a, b) for a, b in links if a is not None])
    assert got == want and set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 9, *range(20, 51)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_repeats_equal_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(suffix_repeats, "BATCH_CHARS", 1500)
    dice = np.random.default_rng(0)
    part = [phrase(30, 40 + k) for k in range(4)]
    mixes = [part[dice.integers(4)][dice.integers(40):] + phrase(5, 60 + k) + part[dice.integers(4)][:dice.integers(60, 200)]
             for k in range(25)]
    many = [*texts, *mixes, "ab" * 80, "ab" * 60, "NOID"]
    got = table(suffix_repeats.remove_repeats(frame(spark, many), 50))
    seen = set()
    for i, t in enumerate(many[:-1]):
        data = (t or "").encode()
        own = {data[j:j + 50] for j in range(len(data) - 49)}
        hit = bytearray(len(data))
        for j in range(len(data) - 49):
            if data[j:j + 50] in seen:
                hit[j:j + 50] = b"\1" * 50
        seen |= own
        kept = bytes(b for b, h in zip(data, hit, strict=True) if not h)
        assert (got[i]["n_bytes"], got[i]["n_removed"]) == (len(data), sum(hit)), i
        assert got[i]["n_spans"] == len(re.findall(b"\1+", bytes(hit)))
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert got[None]["n_removed"] == 0
    assert suffix_repeats.remove_repeats(frame(spark, [])).count() == 0


def test_prefix_intervals():
    # common prefixes of neighbours: a tree with intervals 1:[0..4], 3:[0..1], 2:[2..4], 5:[3..4]
    assert sorted(suffix_repeats.intervals([3, 1, 2, 5], 1)) == [(1, 0, 4), (2, 2, 4), (3, 0, 1), (5, 3, 4)]
    assert list(suffix_repeats.intervals([0, 0], 1)) == []


def test_seeds_meet_every_pair_of_substitutions():
    n = decontaminate.LENGTH
    for gone in combinations(range(n), n - decontaminate.LEAST):
        assert any(not {at + k for k in mask} & set(gone) for mask in decontaminate.MASKS
                   for at in range(n - decontaminate.SPAN + 1))


def test_overlaps(spark, texts):
    item = phrase(25, 70)
    swapped = item.split()
    swapped[3] = swapped[9] = swapped[16] = "other"
    items = spark.createDataFrame([(5, item, "a"), (3, item, "b"), (7, None, "c"), (8, "", "d"), (9, "too short", "e"),
                                   (11, phrase(20, 71), "f")], "item_id long, text string, words string")
    many = [*texts, phrase(500, 72) + " " + " ".join(swapped).upper() + " " + phrase(9, 73), item, item + " " + item,
            " ".join(item.split()[:9]) + " " + phrase(30, 74), "NOID"]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.overlaps(frame(spark, many), items).collect()}
    n = len(texts)
    assert set(got) == {(n, 3), (n + 1, 3), (n + 2, 3)}
    assert (got[n, 3]["doc_word"], got[n, 3]["n_words"], got[n, 3]["n_equal"]) == (500, 25, 22)
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(frame(spark, many), items).collect()}
    assert kept == {None, n + 3, *range(n)}
    assert decontaminate.overlaps(frame(spark, []), items).count() == 0
    assert decontaminate.overlaps(frame(spark, many), items.limit(0)).count() == 0


def test_overlaps_of_short_items_and_scripts_without_spaces(spark):
    chinese = "春天来了,河边的柳树都绿了。孩子们跑到草地上,一起放风筝!老人坐在树下慢慢地喝茶?"
    japanese = "昨日の夜、友達と一緒に古い映画を見ました。とても面白かったです"
    items = spark.createDataFrame([(1, "Who wrote the red book?", ""), (2, phrase(12, 80), ""), (3, chinese, ""),
                                   (4, "什么是光?", ""), (5, "Paris", ""), (6, japanese, ""), (7, "?!", "")],
                                  "item_id long, text string, words string")
    many = [phrase(50, 81) + " Q: who wrote -- the RED book; who wrote the red book " + phrase(50, 82),
            "who wrote the blue book", "wrote the red book", phrase(12, 80), phrase(12, 80)[:-1],
            "前言后语都不同" + chinese.replace("。", " ").replace("柳", "杨") + "别的结尾", "请问什么是光呢", "什么是电",
            "in Paris or Parisian", "parisian", "ああ" + japanese + "ええ", None, "", "who wrote the red", "book", "龍" * 40]
    got = {(r["doc_id"], r["item_id"]): (r["doc_word"], r["n_words"], r["n_equal"])
           for r in decontaminate.overlaps(frame(spark, many), items).collect()}
    assert set(got) == {(0, 1), (3, 2), (5, 3), (6, 4), (8, 5), (10, 6)}
    assert got[0, 1] == (51, 5, 5) and got[3, 2] == (0, 12, 12) and got[8, 5] == (1, 1, 1) and got[6, 4] == (2, 4, 4)
    n = len([c for c in chinese if c not in ",。!?"])
    assert got[5, 3] == (7, n, n - 1) and got[10, 6][0] == 2
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(frame(spark, many), items).collect()}
    assert kept == {1, 2, 4, 7, 9, 11, 12, 13, 14, 15}


def test_quality_separates_held_out_texts(spark):
    good = [phrase(40, k) for k in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in phrase(40, 100 + k).split()) for k in range(60)]
    docs = frame(spark, [x for pair in zip(good, bad, strict=True) for x in pair] + [None, ""])
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(80)] + [(None, 1, 0), (81, None, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, model).collect()}
    assert all(got[i] >= 0.7 if i % 2 == 0 else got[i] < 0.5 for i in range(80, 120))
    assert got[120] == got[121] and 0 <= got[120] <= 1
    kept = quality.keep_good(docs, model, 0.7)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= set(range(0, 120, 2))
    nothing = quality.fit(frame(spark, []), labels)
    assert {r["score"] for r in quality.score_documents(docs, nothing).collect()} == {0.5}
    assert quality.score_documents(frame(spark, []), model).count() == 0


def test_shards(spark, texts):
    many = [*texts, *[phrase(20 + k % 7, 200 + k) for k in range(300)]]
    got = table(kd_shards.shard_documents(frame(spark, many), 8))
    sizes, slots, at = {}, {}, {}
    for i, t in enumerate(many):
        r = got[i]
        assert r["size"] == len((t or "").encode()) + 1
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert at.setdefault(t, r["shard"]) == r["shard"]
    assert set(sizes) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    even = table(kd_shards.shard_documents(frame(spark, [phrase(30, k) for k in range(400)]), 8))
    by = [sum(r["size"] for r in even.values() if r["shard"] == k) for k in range(8)]
    assert max(by) - min(by) < 1000
    assert kd_shards.shard_documents(frame(spark, []), 8).count() == 0
    assert {r["shard"] for r in kd_shards.shard_documents(frame(spark, ["same"] * 20), 8).collect()} == {0}


def test_pivot_links_equal_all_pairs(spark):
    dice = np.random.default_rng(3)
    rows, base = [], dice.normal(size=(25, 16))
    for b in base:
        for _ in range(dice.integers(1, 9)):
            rows.append([float(x) for x in b + dice.normal(size=16) * 0.04 * np.abs(b).mean()])
    data = [(i, v, i % 2) for i, v in enumerate(rows)]
    n = len(data)
    data += [(n, rows[0], 0), (n + 1, rows[0], None), (n + 2, None, 0), (n + 3, [0.0] * 16, 0), (n + 4, [float("nan")] * 16, 0),
             (n + 5, [None] * 16, 0), (n + 6, [], 0), (n + 7, [x * 3 for x in rows[0]], 0), (n + 8, rows[0][:4], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = table(pivots.near_vectors(df, 0.98), "vec_id")
    fine = [(i, np.array(v, float), k) for i, v, k in data if k is not None and v and None not in v
            and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for (a, x, k), (b, y, m) in combinations(fine, 2)
             if k == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98]
    want = roots([i for i, _, _ in data], links)
    for i, _, _ in data:
        assert got[i]["n_links"] == sum(i in pair for pair in links), i
        assert got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i)
    assert pivots.near_vectors(df.limit(0), 0.98).count() == 0


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def test_url_rules_and_propagation(spark):
    pages = [(1, "https://A.Example.org/es/1?x#y", ""), (2, "http://example.org/en", '<a href="http://near.net/x">'),
             (3, None, None), (4, "nothing", ""), (5, "x://bad.com/de/1", '<a href=//near2.net/>'), (6, "https://near.net/a", ""),
             (7, "https://to-bad.net", '<a href="https://bad.com/q">' * 3), (8, "https://near2.net?q=/fr/", ""),
             (9, "http://www.shop.com/fr/", ""), (9, "http://www.shop.com/fr/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = url_trust.judge_pages(df, RULES).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == 10
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en", "org/", "allow") and got[3] == ("", "", None, "allow") == got[4]
    assert got[5][2:] == ("com/de/", "block") and got[9][2:] == ("com/fr/", "allow")
    assert got[6][3] == "allow" and got[7] == ("to-bad.net", "", None, "block")     # it links to a blocked host
    assert got[8][3] == "allow"
    trust = {r["page_id"]: (r["trust"], r["distrust"]) for r in rows}
    assert trust[6][0] > 0 and trust[6][1] == 0 and trust[7][1] > 0
    assert url_trust.judge_pages(df.limit(0), RULES).count() == 0


def test_propagation_equals_plain_iteration(spark):
    dice = np.random.default_rng(5)
    edges = {(f"h{a}", f"h{b}"): int(n) for a, b, n in dice.integers(1, 9, (40, 3)) if a != b}
    seeds = {"h1": 3, "h2": 1}
    got = {r["host"]: r["rank"] for r in url_trust.propagate(
        spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, links long"),
        spark.createDataFrame(list(seeds.items()), "host string, weight long")).collect()}
    start = {h: url_trust.WHOLE * w // 4 * 15 // 100 for h, w in seeds.items()}
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    rank = dict(start)
    for _ in range(url_trust.ROUNDS):
        following = dict(start)
        for (a, b), n in edges.items():
            following[b] = following.get(b, 0) + rank.get(a, 0) * 85 // 100 * n // out[a]
        rank = {h: r for h, r in following.items() if r}
    assert got == rank


def test_propagation_goes_on_until_ranks_settle(spark):
    chain = [(k, f"https://c{k}.net/", f'<a href="https://c{k + 1}.net/">') for k in range(23)]
    pages = [*chain, (23, "https://c23.net/", '<a href="https://bad.com/">'), (24, "https://bad.com/de/1", ""),
             (25, "https://good.org/", '<a href="https://other.net/">'), (26, "https://other.net/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["distrust"]) for r in url_trust.judge_pages(df, RULES).collect()}
    for k in range(24):                                          # c0 leads to the blocked host over 24 links
        assert got[k][0] == "block" and abs(float(got[k][1]) / (1e30 * 0.15 * 0.85 ** (24 - k)) - 1) < 1e-9
    assert got[25][0] == got[26][0] == "allow"


def test_small_seeds_pass_hubs(spark):
    edges = [("bad", "hub", 1), ("hub", "next", 1), ("hub", "many", 10 ** 7), ("next", "hub2", 1), ("hub2", "last", 1),
             ("hub2", "many", 10 ** 7)]
    seeds = [("bad", 1), ("big", 10 ** 10)]
    got = {r["host"]: r["rank"] for r in url_trust.propagate(spark.createDataFrame(edges, "src string, dst string, links long"),
           spark.createDataFrame(seeds, "host string, weight long"), rounds=50, settle=True).collect()}
    share = 1e30 / (10 ** 10 + 1) * 0.15 * 0.85 ** 4 / (10 ** 7 + 1) ** 2
    assert abs(float(got["last"]) / share - 1) < 1e-3
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, links long")
    with pytest.raises(RuntimeError):
        url_trust.propagate(edges, spark.createDataFrame([("a", 1)], "host string, weight long"), rounds=20, settle=True)
