"""Connected components of links between 64-bit keys, by alternating star steps.

Every step is two small joins over the links that are left; each result is written to the shared folder, so lineage stays
short and the result before it is deleted. Minima are taken by grouped aggregation (combined before the shuffle) and joined
back. Nodes with very many links get their minimum by broadcast, so that their links never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Links of a node from which it is a hub; of all links at most one in 10,000 times as many nodes are.
HUB = 1_000_000


def _to_least(links: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """Links with the minimum ``m`` of their node u; hubs, of which there are few, are broadcast."""
    if not hub:
        return links.join(least.drop("n"), "u")
    hubs = F.broadcast(least.where(F.col("n") >= hub).drop("n"))
    rest = links.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") < hub).drop("n"), "u")
    return rest.unionByName(links.join(hubs, "u"))


def _star(links: DataFrame, large: bool, hub: int = 0) -> DataFrame:
    """One step over links (u, v) with u > v. large: neighbours above a node move to its least neighbour; else those below."""
    if large:
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        out = _to_least(around.where("v > u"), least, hub).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        out = _to_least(links, least, hub).select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link to another; root is the least node reachable. ``links`` has u and v.

    Links of a node to itself and repeated links do not matter; an empty table gives an empty result.
    """
    now = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    state, n = None, now.count()
    while True:
        # fewer links than HUB cannot make a hub
        step = materialize(_star(_star(now, True, max(HUB, n // 10_000) if n >= HUB else 0), False, max(HUB, n // 10_000) if n >= HUB else 0))
        discard(now)
        now = step
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        n = seen[0]
        if tuple(seen) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = tuple(seen)
