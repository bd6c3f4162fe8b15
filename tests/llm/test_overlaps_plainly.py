"""Overlaps against every alignment compared word by word."""

import re

import numpy as np

from shoplake.llm import decontaminate


def plain(doc, item):
    """(n_words, n_equal) of the longest overlap over all alignments, or None."""
    d, t = (re.findall(r"[a-z0-9]+", x.lower()) for x in (doc, item))
    best = None
    if len(t) < decontaminate.LENGTH:
        return (len(t), len(t)) if t and any(d[i:i + len(t)] == t for i in range(len(d) - len(t) + 1)) else None
    for shift in range(-len(t) + 1, len(d)):
        same = [0 <= k + shift < len(d) and d[k + shift] == t[k] for k in range(len(t))]
        inside = [0 <= k + shift < len(d) for k in range(len(t))]
        covered = set()
        for k in range(len(t) - decontaminate.LENGTH + 1):
            window = range(k, k + decontaminate.LENGTH)
            if all(inside[j] for j in window) and sum(same[j] for j in window) >= decontaminate.LEAST:
                covered.update(window)
        run = []
        for k in [*sorted(covered), None]:
            if run and k != run[-1] + 1:
                hits = [j for j in run if same[j]]
                found = (hits[-1] - hits[0] + 1, len(hits))
                best = max(best or found, found)
                run = []
            if k is not None:
                run.append(k)
    return best


def test_overlaps_equal_all_alignments(spark):
    dice = np.random.default_rng(5)
    names = [f"w{i}" for i in range(12)]
    items = [" ".join(dice.choice(names, int(dice.integers(13, 40)))) for _ in range(12)] + ["a " * 40, "a b " * 20, "w1 w2 w3", "lone"]
    docs = []
    for k in range(60):
        parts = [" ".join(dice.choice(names, int(dice.integers(0, 30)))) for _ in range(2)]
        words = items[k % len(items)].split()
        low = int(dice.integers(0, max(1, len(words) - 13)))
        cut = words[low:low + int(dice.integers(10, 30))]
        for _ in range(int(dice.integers(0, 4))):
            cut[int(dice.integers(len(cut)))] = "zz"
        docs.append(f"{parts[0]} {' '.join(cut)} {parts[1]}")
    docs += ["a " * 300, "b a " * 100, "", "lone lone", "w1, W2-w3"]
    got = {(r["doc_id"], r["item_id"]): (r["n_words"], r["n_equal"]) for r in decontaminate.overlaps(
        spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"),
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = {(i, j): p for i, d in enumerate(docs) for j, t in enumerate(items) if (p := plain(d, t))}
    assert got == want and len(want) > 40


def test_a_long_text_of_one_word(spark):
    docs = spark.createDataFrame([(1, "ha " * 200_000), (2, "other " * 200_000 + "ha " * 20)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ha " * 200)], "item_id long, text string")
    got = decontaminate.overlaps(docs, items).collect()
    assert sorted((r["doc_id"], r["n_words"]) for r in got) == [(1, 200), (2, 20)]
