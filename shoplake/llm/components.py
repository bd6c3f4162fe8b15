"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplake.llm.shared import stored


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node in `links` (a long, b long); the component is its smallest node.

    Each round hangs a node's larger neighbours, then its smaller ones, on the smallest;
    chains shorten by half and more, so the number of rounds is logarithmic. Minima are
    aggregated map-side and stored, so that joins on a hub's rows can be split. Self
    links, repeats and null ends are left out; no links give no rows.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                   .distinct(), label)
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")) \
                .unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        seen = mark
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")) \
            .unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"))
                       .select("u", F.least("u", "m").alias("m")), label)
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
                       .distinct(), label)
        least = stored(large.groupBy("hi").agg(F.min("lo").alias("m")), label)
        joined = large.join(least, "hi")
        edges = stored(joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                       .unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), label)
