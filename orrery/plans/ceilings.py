"""Composition ceilings over the mask proposals of ``plans.masks``, against longer true objects than its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import ceilings as ops
from orrery.plans.masks import PRELUDE, masks
from orrery.sources.tables import settled

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Vertices of a true object, and candidates, small enough that the bound shows.
BLOCK, CANDIDATES = 150, 24


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def objects(raw: DataFrame) -> DataFrame:
    return raw.select("scene_id", F.floor(F.col("v") / BLOCK).cast("long").alias("p"), "v").distinct()


_TRUE = f"""WITH RECURSIVE {PRELUDE}, obj AS MATERIALIZED (SELECT DISTINCT scene_id, v // {BLOCK} AS q, v FROM mask
), osize AS (SELECT scene_id, q, count(*) AS size_q FROM obj GROUP BY ALL
), met AS MATERIALIZED (SELECT m.scene_id, o.q, m.p, count(*) AS shared FROM mask m JOIN obj o USING (scene_id, v) GROUP BY ALL)"""


def _step(k: int) -> str:
    return f"""
, tried{k} AS (
  SELECT f.scene_id, f.q, f.p, s.shared + sum(inside) AS shared, s.size + count(*) AS size, (s.shared + sum(inside)) / (s.size + count(*) + any_value(size_q) - s.shared - sum(inside)) AS iou, any_value(s.iou) AS was
  FROM fresh{k - 1} f JOIN best{k - 1} s USING (scene_id, q) JOIN osize USING (scene_id, q) GROUP BY f.scene_id, f.q, f.p, s.shared, s.size
), best{k} AS MATERIALIZED (SELECT scene_id, q, p, shared, size, iou FROM tried{k} WHERE iou > was QUALIFY row_number() OVER (PARTITION BY scene_id, q ORDER BY iou DESC, p) = 1
), fresh{k} AS MATERIALIZED (
  SELECT f.* FROM fresh{k - 1} f ANTI JOIN (SELECT b.scene_id, b.q, m.v FROM best{k} b JOIN mask m USING (scene_id, p)) h ON h.scene_id = f.scene_id AND h.q = f.q AND h.v = f.v
)"""


_CURVE = f"""{_TRUE}
, cand AS MATERIALIZED (
  SELECT scene_id, q, p, met FROM (SELECT *, count(*) OVER (PARTITION BY scene_id, q) AS met FROM met) QUALIFY row_number() OVER (PARTITION BY scene_id, q ORDER BY shared DESC, p) <= {CANDIDATES}
), fresh0 AS MATERIALIZED (SELECT s.scene_id, s.q, s.p, m.v, (o.v IS NOT NULL)::BIGINT AS inside FROM cand s JOIN mask m USING (scene_id, p) LEFT JOIN obj o ON o.scene_id = s.scene_id AND o.q = s.q AND o.v = m.v
), best0 AS (SELECT DISTINCT scene_id, q, NULL::BIGINT AS p, 0::BIGINT AS shared, 0::BIGINT AS size, 0e0 AS iou FROM cand){"".join(map(_step, range(1, ops.STEPS + 1)))}
, steps AS ({" UNION ALL ".join(f"SELECT scene_id, q, {k} AS step, p, iou FROM best{k}" for k in range(1, ops.STEPS + 1))})"""


def _curve(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    raw = settled(masks(spark, sf), "masks")
    true = settled(objects(raw), "objects")
    return ops.union_curve(raw, true, candidates=CANDIDATES), true


@_query(f"{_CURVE} SELECT s.scene_id, s.q, step, s.p, round(iou, 4) AS iou, met, met > {CANDIDATES} AS capped FROM steps s JOIN (SELECT DISTINCT scene_id, q, met FROM cand) USING (scene_id, q)")
def composition_curve(spark: SparkSession, sf: str) -> DataFrame:
    """The masks of each object's greedy union and the IoU after each."""
    return _curve(spark, sf)[0].withColumn("iou", F.round("iou", 4))


@_query(f"""{_CURVE}, b AS (SELECT scene_id, q, max(iou) FILTER (step <= 1) AS single, max(iou) FILTER (step <= 2) AS union2, max(iou) FILTER (step <= 3) AS union3, max(iou) AS union_any FROM steps GROUP BY ALL
), f AS (UNPIVOT b ON single, union2, union3, union_any INTO NAME field VALUE iou)
SELECT scene_id, field, threshold, round(count(*) FILTER (round(iou, 4) >= threshold) / any_value(n), 4) AS recall FROM f JOIN (SELECT scene_id, count(*) AS n FROM osize GROUP BY ALL) USING (scene_id), (SELECT unnest([0.5e0, 0.75e0]) AS threshold) GROUP BY ALL""")
def composition_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    """Share of objects that one mask, or a union of two, three or more, could deliver."""
    return ops.recall(*_curve(spark, sf))


@_query(f"""{_TRUE}
, able AS (SELECT scene_id, q, p, shared / (size + size_q - shared) AS iou FROM met JOIN size USING (scene_id, p) JOIN osize USING (scene_id, q) WHERE shared / (size + size_q - shared) >= {ops.VIABLE}
), listed AS (SELECT scene_id, q, list(p ORDER BY iou DESC, p DESC) AS ps, row_number() OVER (PARTITION BY scene_id ORDER BY max(iou) DESC, q) AS n FROM able GROUP BY scene_id, q
), turn AS (
  SELECT scene_id, 0::BIGINT AS n, NULL::BIGINT AS q, NULL::BIGINT AS p, NULL::BIGINT AS rank, []::BIGINT[] AS taken FROM (SELECT DISTINCT scene_id FROM listed)
  UNION ALL SELECT t.scene_id, l.n, l.q, free[1], list_position(ps, free[1]) - 1, CASE WHEN len(free) > 0 THEN list_append(taken, free[1]) ELSE taken END
  FROM (SELECT t.*, l.n AS ln, l.q AS lq, l.ps AS lps, list_filter(l.ps, lambda x: NOT list_contains(t.taken, x)) AS free FROM turn t JOIN listed l ON l.scene_id = t.scene_id AND l.n = t.n + 1) t JOIN listed l ON l.scene_id = t.scene_id AND l.n = t.ln
)
SELECT scene_id, q, p, round(iou, 4) AS iou, rank FROM turn JOIN able USING (scene_id, q, p)""")
def joint_nomination(spark: SparkSession, sf: str) -> DataFrame:
    """One mask for each object, objects in order of the best that they could have."""
    raw = settled(masks(spark, sf), "masks")
    found = ops.nominated(raw, raw.select("scene_id", F.floor(F.col("v") / BLOCK).cast("long").alias("p"), "v").distinct())
    return found.withColumn("iou", F.round("iou", 4)).withColumn("rank", F.col("rank").cast("long"))
