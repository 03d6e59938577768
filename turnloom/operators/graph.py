"""Connected components of a graph that fits no single machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node of ``edges`` (``a``, ``b``: bigint).

    Direction, loops and repeated edges make no difference; edges with a null end are ignored; without edges
    the result is empty. Each round gives every node the smallest node it has seen next to itself or its
    neighbours and replaces every edge by one between these, which shortens long chains by halves; it ends
    when nothing changes, and only that one number comes to the driver.
    """
    both = edges.where("a is not null and b is not null").select("a", "b")
    links = cut(both.where("a != b").unionByName(both.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lone = both.select(F.col("a").alias("node")).unionByName(both.select(F.col("b").alias("node"))).distinct()
    parents = cut(lone.withColumn("component", F.col("node")))
    for _ in range(rounds):
        # Where nodes know of a smaller one nearby, they point there; then each takes over what that one points to.
        near = links.join(parents, links["b"] == parents["node"]).groupBy("a").agg(F.min("component").alias("seen"))
        hooked = parents.join(near, parents["node"] == near["a"], "left").select("node", F.least("component", F.coalesce("seen", "component")).alias("component"), F.col("component").alias("was"))
        # The old parent of a node learns of the smaller one, too.
        told = hooked.groupBy(F.col("was").alias("t")).agg(F.min("component").alias("told"))
        known = cut(hooked.join(told, hooked["node"] == told["t"], "left").select("node", F.least("component", F.coalesce("told", "component")).alias("component"), "was"))
        up = known.select(F.col("node").alias("up"), F.col("component").alias("upper"))
        jumped = cut(known.join(up, known["component"] == up["up"]).select("node", F.least("component", "upper").alias("component"), "was"))
        changed = jumped.where("component != was").limit(1).count()
        parents = jumped.select("node", "component")
        if not changed:
            return parents
    raise RuntimeError(f"components did not settle in {rounds} rounds")
