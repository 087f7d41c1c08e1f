"""Connected components by alternating large-star and small-star steps.

Each step is a grouping and a join on the node, both of which Spark can split
for a node with very many links; no component is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import durable


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `component` (smallest node reachable) of every node of a link between two different nodes.

    Null ends, loops and repeated links are ignored; no links give no rows.
    """
    pairs = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo")
    pairs = pairs.where(F.col("hi").isNotNull() & F.col("lo").isNotNull()).distinct()
    pairs, seen = durable(pairs), None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = pairs.union(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("top"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("top").alias("lo"))
        large = large.where("hi > lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("top"))
        small = large.join(least, "hi").where("lo > top").select(F.col("lo").alias("hi"), F.col("top").alias("lo"))
        pairs = durable(small.union(least.select("hi", F.col("top").alias("lo"))).distinct())
    found = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
