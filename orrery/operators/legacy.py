"""Label retrieval by weighted rules: parse, score, filter, first k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spatial phrases of a query and their relation.
SPATIAL = (("left of", "LEFT_OF"), ("right of", "RIGHT_OF"), ("in front of", "IN_FRONT_OF"), ("behind", "BEHIND"), ("below", "BELOW"), ("under", "BELOW"), ("above", "ABOVE"), ("near", "NEAR"))
#: Results kept by intent.
TOP = {"spatial": 10, "label": 6, "other": 4}


def parse(queries: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """``queries`` (with ``query``) and ``intent, relation, anchor``: the first phrase found, then the longest label."""
    text = F.lower("query")
    relation = F.coalesce(*[F.when(text.contains(phrase), F.lit(kind)) for phrase, kind in SPATIAL])
    named = F.coalesce(*[F.when(text.contains(label), F.lit(label)) for label in sorted(labels, key=lambda x: (-len(x), x))])
    intent = F.when(relation.isNotNull() & named.isNotNull(), "spatial").when(named.isNotNull(), "label").otherwise("other")
    return queries.select("*", intent.alias("intent"), relation.alias("relation"), named.alias("anchor"))


def salience(distance: Column) -> Column:
    """Fall-off of vertical relations with horizontal distance."""
    return F.least(F.greatest(1 - 0.38 * distance, F.lit(0.05)), F.lit(1.0))


def locality(distance: Column) -> Column:
    """Bonus of nearness for left and right."""
    return 0.5 * F.greatest(F.lit(0.0), 1 - distance / 5)


def score(rows: DataFrame, version: int = 1) -> DataFrame:
    """``rows`` with ``score``: weight of the relation, times salience (vertical) or plus locality (version 2).

    rows: intent, relation, weight (of the best edge, null if none), same_label, xy.
    """
    weight = F.coalesce("weight", F.lit(0.0))
    vertical = F.col("relation").isin("BELOW", "ABOVE")
    near_by = F.when(F.col("relation").isin("LEFT_OF", "RIGHT_OF") & (weight > 0), locality(F.col("xy"))).otherwise(0.0) if version == 2 else F.lit(0.0)
    spatial = F.when(vertical, weight * salience(F.col("xy"))).otherwise(weight + near_by)
    value = F.when(F.col("intent") == "spatial", spatial).when(F.col("same_label"), 0.75).otherwise(0.0)
    return rows.withColumn("score", F.round(value, 3))


def top_k(rows: DataFrame, group: list[str], least: float = 0.2) -> DataFrame:
    """Rows of at least ``least``, the first of each group by score, then order; how many depends on the intent."""
    limit = F.lit(TOP["other"])
    for intent, n in TOP.items():
        limit = F.when(F.col("intent") == intent, n).otherwise(limit)
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "ord")
    ranked = rows.where(F.col("score") >= least).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit)
