"""Connected components of a link table, by alternating large and small stars.

Links stay rows. In a large star every node sends its larger neighbours to the smallest
node it knows, in a small star its smaller ones; both keep the components and shorten
paths, so a few rounds (about the logarithm of the longest path) end in stars around
each component's smallest node. A node's smallest neighbour is an aggregate with
map-side combine, and it meets the links in a join that adaptive execution may split,
so a node with very many links is no hot task. Every round is written to the shared
folder; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfall.llm.text import store


def star(links: DataFrame, large: bool) -> DataFrame:
    """One round over links (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    least = least.select("c", F.least("c", "m").alias("m"))
    near = both.join(least, F.col("u") == F.col("c"))
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("l")).select("l.*")
    return out.where("u <> v").distinct()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """node and label (the smallest node reachable) for every node of ``links`` (a, b) that
    is linked to another. Links may repeat and point either way."""
    now = store(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                "links")
    seen = None
    for _ in range(rounds):
        now = store(star(store(star(now, large=True), "star"), large=False), "star")
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    label = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return label.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
