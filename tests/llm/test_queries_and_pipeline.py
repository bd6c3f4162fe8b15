"""The registered queries' own columns, and the pipeline stage by stage against plain versions."""

import hashlib
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shoplake.llm import quality, queries
from test_overlaps_plainly import plain as overlap
from test_text_operators import phrase, roots

GOOD = "the river runs past green houses and quiet birds sing at dawn over the old stone bridge"


def sentence(seed, n):
    dice = np.random.default_rng(seed)
    return " ".join(dice.choice(GOOD.split(), n)) + f" no {seed}."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    base = [sentence(i, 60) for i in range(40)]
    item = phrase(25, 900)
    junk = [f"BUY BUY $$$ {i} click click ### now now !!! " * 8 for i in range(40)]
    texts = [*base, *junk, base[3], base[4] + " end", base[5] + " " + item, base[6] + " password = abc12345 done", None, ""]
    docs = [(i, t, ["en", None][i % 2], "src", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(i < 40), 0) for i in range(80)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, docs


def shingles(text, n=5):
    words = (text or "").split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_pipeline_stages_equal_plain_versions(spark, folder):
    root, docs = folder
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {d[0]: d for d in docs}
    frame = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = corpus_pipeline.stored(stage(spark, frame, root), f"test-{name}")
        if name == "quality":
            model = quality.fit(frame, queries.training_labels(spark, root))
            want = {i: d for i, d in kept.items() if model.scores([d[1] or ""])[0] >= queries.LEAST_QUALITY}
            assert set(range(40)) <= set(want) and not set(range(40, 80)) & set(want)
        elif name == "near_dedup":
            sets = {i: shingles(d[1]) for i, d in kept.items()}
            near = [(a, b) for a, b in combinations(kept, 2) if kept[a][1] == kept[b][1]
                    or sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            label = roots(list(kept), near)
            want = {i: d for i, d in kept.items() if label[i] == i}
            assert len(want) < len(kept)
        elif name == "decontaminate":
            item = spark.read.parquet(f"{root}/benchmark.parquet").first()["text"]
            want = {i: d for i, d in kept.items() if not overlap(d[1] or "", item)}
            assert set(kept) - set(want) == {82}
        elif name == "secret_scan":
            want = {i: (*d[:1], d[1] and d[1].replace("password = abc12345", "[assign]"), *d[2:4],
                        d[4] - len("password = abc12345") + len("[assign]") if i == 83 else d[4]) for i, d in kept.items()}
        else:
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            found = {r["doc_id"]: r for r in got.collect()}
            assert set(found) == set(kept)
            for i, d in kept.items():
                ids = library.encode(d[1] or "", add_special_tokens=False).ids
                assert found[i]["n_tokens"] == len(ids)
                assert found[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            break
        assert got.columns == columns
        assert {r["doc_id"]: tuple(r) for r in got.collect()} == want
        kept, frame = want, got
    whole = {r["doc_id"]: tuple(r) for r in corpus_pipeline.run(spark, root).collect()}
    assert whole == {i: tuple(r) for i, r in found.items()}


def test_columns_of_the_queries(spark, folder):
    root, docs = folder
    scored = {r["doc_id"]: r for r in queries.op6_quality(spark, root).collect()}
    assert len(scored) == len(docs)
    for i, r in scored.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
    assert all(scored[i]["predicted"] == int(i < 40) for i in range(80) if scored[i]["held_out"])
    counts = {r["doc_id"]: r for r in queries.op4_token_counts(spark, root).collect()}
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in counts.values()) and len(counts) == len(docs)
    shards = queries.op7_kd_shards(spark, root).collect()
    slots = {}
    for r in shards:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(shards) == len(docs)
    prints = queries.op9_simhash(spark, root).collect()
    assert all(len(r["fingerprint"]) == 16 and r["fingerprint"] == r["fingerprint"].lower() for r in prints)
    assert {r["doc_id"]: r["component_id"] for r in prints}[80] == 3


def test_training_features_are_bounded(spark, folder, monkeypatch):
    root, docs = folder
    monkeypatch.setattr(quality, "TRAIN_BYTES", 1)
    model = quality.fit(spark.read.parquet(f"{root}/documents.parquet"), queries.training_labels(spark, root))
    assert model.scores(["any text"]) == [0.5]
