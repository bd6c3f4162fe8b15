"""Anchors with many different surroundings against brute force."""

import numpy as np
import pytest

from shoplake.llm import suffix_repeats


def removed_plainly(texts, length):
    """Bytes of each text covered by a string that also starts in an earlier one."""
    first = {}
    for i, t in enumerate(texts):
        for at in range(len(t) - length + 1):
            first.setdefault(t[at:at + length], i)
    out = []
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for at in range(len(t) - length + 1):
            if first[t[at:at + length]] < i:
                gone[at:at + length] = True
        out.append(int(gone.sum()))
    return out


@pytest.mark.parametrize("bound", [1, 3, 10**9])
def test_hot_anchors_equal_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(suffix_repeats, "HOT_ROWS", bound)
    dice = np.random.default_rng(bound % 97)
    phrase = b"a phrase that very many documents share between others "
    words = [f"w{i} ".encode() for i in range(9)]

    def noise(n):
        return b"".join(words[i] for i in dice.integers(0, len(words), n))
    texts = [noise(int(dice.integers(0, 12))) + phrase + noise(int(dice.integers(0, 12))) for _ in range(60)]
    texts += [noise(40) for _ in range(10)] + [texts[3], b"", texts[5] + texts[9], b"x" * 200, b"x" * 120, phrase[:49], phrase[:50]]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert (suffix_repeats.hot_anchors(suffix_repeats.texts(df), 50) is None) == (bound == 10**9)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_repeats.remove_repeats(df, 50).collect()}
    assert [got[i] for i in range(len(texts))] == removed_plainly(texts, 50)
