"""Connected components within groups, by stars that contract: no group is gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.sources.tables import settled


def _to_least(edges: DataFrame, group: list[str]) -> DataFrame:
    """Every node's greater neighbours move to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(*group, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*group, "u").agg(F.min("v").alias("m")).select(*group, "u", F.least("u", "m").alias("m"))
    return both.join(least, [*group, "u"]).where("v > u and v <> m").select(*group, F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _below_least(edges: DataFrame, group: list[str]) -> DataFrame:
    """Every node's smaller neighbours, and itself, move to the least of them."""
    least = edges.groupBy(*group, "u").agg(F.min("v").alias("m"))
    moved = edges.join(least, [*group, "u"]).select(*group, F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(*group, "u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, group: list[str], a: str, b: str, rounds: int = 60) -> DataFrame:
    """``*group, node, root`` of every node with an edge, loops included; root is the least node reachable.

    A node without any edge is not in the result. Each round is settled in the shared
    folder; the driver sees a count and a checksum. A path of n nodes takes
    about log n rounds, however many edges a node or a group has.
    """
    links = edges.select(*group, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    nodes = links.select(*group, F.col("u").alias("node")).unionByName(links.select(*group, F.col("v").alias("node"))).distinct()
    current = settled(links.where("u <> v"), "links")
    seen = None
    for _ in range(rounds):
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*group, "u", "v") % 1_000_000_007)).first()
        if not state[0] or state == seen:
            break
        seen = state
        current = settled(_below_least(_to_least(current, group), group), "stars")
    else:
        raise RuntimeError("components did not settle")
    roots = current.groupBy(*group, "u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return nodes.join(roots, [*group, "node"], "left").withColumn("root", F.coalesce("root", "node"))
