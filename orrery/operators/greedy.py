"""Greedy choices without a loop over a group: who loses when the best come first.

Going through nodes from best to worst and keeping each that conflicts with none kept is the same
as deciding in rounds: a node without a better undecided rival is kept, and its rivals go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.sources.tables import settled


def losers(conflicts: DataFrame, key: list[str], rounds: int = 1000) -> DataFrame:
    """``*key, node``: nodes that lose to a kept one. conflicts: *key, better, worse (one row a pair).

    Nodes without conflicts are none of its concern. Every round decides at least the
    best undecided node of each key; it needs as many rounds as the longest chain of
    decisions, which is short where conflicts are local.
    """
    left = settled(conflicts.select(*key, "better", "worse").distinct(), "conflicts")
    gone = None
    for _ in range(rounds):
        if left.isEmpty():
            break
        blocked = left.select(*key, F.col("worse").alias("better")).distinct()
        kept = left.select(*key, "better").distinct().join(blocked, [*key, "better"], "left_anti")
        out = settled(left.join(kept, [*key, "better"], "left_semi").select(*key, F.col("worse").alias("node")).distinct(), "losers")
        gone = out if gone is None else gone.unionByName(out)
        still = left.join(out.withColumnRenamed("node", "better"), [*key, "better"], "left_anti")
        left = settled(still.join(out.withColumnRenamed("node", "worse"), [*key, "worse"], "left_anti"), "conflicts")
    else:
        raise RuntimeError("greedy choices did not settle")
    return left.select(*key, F.col("better").alias("node")) if gone is None else gone.distinct()
