"""K-d shards against a plain tree built from the same points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplake.llm import kd_shards


def plain(points, leaves):
    """Shard of each point (positions, weight): nodes cut one by one."""
    def grow(node, members, parts):
        if parts < 2 or not members:
            return {node: members}
        low = [min(p[0][d] for p in members) for d in range(len(members[0][0]))]
        high = [max(p[0][d] for p in members) for d in range(len(low))]
        wide = [((h >> kd_shards.HASH_BITS) + 1) / ((a >> kd_shards.HASH_BITS) + 1) for a, h in zip(low, high, strict=True)]
        dim = max(range(len(low)), key=lambda d: (wide[d], high[d] - low[d]))
        if high[dim] == low[dim]:
            return {node: members}
        first = parts // 2
        need = sum(p[1] for p in members) * first / parts
        total, cut = 0, None
        for position in sorted({p[0][dim] for p in members}):
            total += sum(p[1] for p in members if p[0][dim] == position)
            if total >= need:
                cut = position
                break
        return {**grow(2 * node + 1, [p for p in members if p[0][dim] <= cut], first),
                **grow(2 * node + 2, [p for p in members if p[0][dim] > cut], parts - first),
                **{c: [] for c in ()}}
    return grow(0, points, leaves)


@pytest.mark.parametrize("leaves", [1, 2, 5, 16])
def test_shards_equal_a_plain_tree(spark, leaves):
    dice = np.random.default_rng(leaves)
    rows = [(int(i), int(dice.integers(0, 1000)), int(dice.integers(0, 40)), int(dice.integers(1, 500)), f"g{i}", "x") for i in range(120)]
    rows += [(200 + i, 7, 3, 50, "same", "x") for i in range(10)] + [(300, None, None, None, "none", "x")]
    df = spark.createDataFrame(rows, "id long, a long, b long, w long, g string, node string")
    placed = df.select("id", F.coalesce("w", F.lit(0)).alias("w"), *[kd_shards._position(d, "g").alias(f"p_{d}") for d in "ab"]).collect()
    points = [((r["p_a"], r["p_b"]), r["w"], r["id"]) for r in placed]
    want = {}
    for k, (_, members) in enumerate(sorted(plain(points, leaves).items())):
        want |= {p[2]: k for p in members}
    got = kd_shards.kd_shards(df, ["a", "b"], "w", "g", leaves=leaves)
    assert got.columns == [*df.columns, "shard"]
    found = {r["id"]: r["shard"] for r in got.collect()}
    assert found == want and len(set(found.values())) == leaves
    assert kd_shards.kd_shards(df.limit(0), ["a"], "w", "g", leaves=leaves).count() == 0
