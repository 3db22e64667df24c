"""Repaired selections and query-scoped expansion over the mask proposals of ``plans.masks``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import contact
from orrery.operators import masks as m
from orrery.operators import repair as ops
from orrery.operators.boxjoin import footprints_meeting
from orrery.plans.masks import _POLICY, PRELUDE, masks, proposals
from orrery.sources.tables import apart, settled

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def rescored(spark: SparkSession, sf: str) -> DataFrame:
    """The proposals with scores that leave about a fifth under the base."""
    return proposals(spark, sf).select("scene_id", "p", ((F.col("p") * 61 % 100) / 100).alias("score"))


_SCORED = f"""WITH RECURSIVE {PRELUDE}, sc AS MATERIALIZED (SELECT scene_id, p, (p * 61 % 100) / 100 AS score, size FROM prop JOIN size USING (scene_id, p)
), base AS (SELECT * FROM sc WHERE score >= {ops.BASE_SCORE}
), way AS MATERIALIZED (SELECT scene_id, p AS parent, q AS child, shared, size_p AS ps, size_q AS cs, iou FROM over UNION ALL SELECT scene_id, q, p, shared, size_q, size_p, iou FROM over)"""


def _children(least: int) -> str:
    """Greedy children of each parent, one after the other."""
    return f"""
kid AS MATERIALIZED (
  SELECT w.*, b.score, row_number() OVER (PARTITION BY w.scene_id, parent ORDER BY cs DESC, child) AS n FROM way w JOIN base b ON b.scene_id = w.scene_id AND b.p = parent
  WHERE shared >= 0.8 * cs AND cs <= 0.5 * ps AND cs >= {least}
), rival AS (SELECT scene_id, p, list(q) AS qs FROM (SELECT scene_id, p, q FROM over WHERE shared / least(size_p, size_q) > 0.2 UNION ALL SELECT scene_id, q, p FROM over WHERE shared / least(size_p, size_q) > 0.2) GROUP BY ALL
), walk AS (
  SELECT scene_id, parent, 0::BIGINT AS n, NULL::BIGINT AS child, []::BIGINT[] AS kept FROM (SELECT DISTINCT scene_id, parent FROM kid)
  UNION ALL SELECT w.scene_id, w.parent, k.n, CASE WHEN NOT list_has_any(kept, coalesce(qs, [])) THEN k.child END, CASE WHEN NOT list_has_any(kept, coalesce(qs, [])) THEN list_append(kept, k.child) ELSE kept END
  FROM walk w JOIN kid k ON k.scene_id = w.scene_id AND k.parent = w.parent AND k.n = w.n + 1 LEFT JOIN rival r ON r.scene_id = k.scene_id AND r.p = k.child
), split AS MATERIALIZED (
  SELECT scene_id, parent, child, k.score FROM walk w JOIN kid k USING (scene_id, parent, child) WHERE w.child IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY scene_id, parent) >= 2 AND sum(shared) OVER (PARTITION BY scene_id, parent) >= 0.5 * max(ps) OVER (PARTITION BY scene_id, parent)
)"""


def _twice(priority: str) -> str:
    """Two resolutions, the second without masks that keep under a half."""
    best = lambda t: f"SELECT scene_id, v, p FROM mask JOIN {t} USING (scene_id, p) QUALIFY row_number() OVER (PARTITION BY scene_id, v ORDER BY pr DESC, p) = 1"
    return f"""
pr AS MATERIALIZED ({priority}
), won AS (SELECT scene_id, p, count(*) AS n FROM ({best("pr")}) GROUP BY ALL HAVING count(*) >= 20
), stay AS MATERIALIZED (SELECT scene_id, p, pr FROM pr JOIN size USING (scene_id, p) JOIN won USING (scene_id, p) WHERE n >= 0.5 * size
), again AS MATERIALIZED ({best("stay")})
SELECT scene_id, v, p FROM again SEMI JOIN (SELECT scene_id, p FROM again GROUP BY ALL HAVING count(*) >= 20) k USING (scene_id, p)"""


def _lifted(size: float, others: int, split: bool) -> str:
    more = " UNION ALL SELECT scene_id, child, score + 1e-6 FROM split" if split else ""
    return f"""SELECT s.scene_id, s.p, greatest(CASE WHEN s.score >= {ops.BASE_SCORE} THEN s.score ELSE -1 END, coalesce(lift, -1)) AS pr FROM sc s LEFT JOIN (
  SELECT scene_id, p, max(lift) AS lift FROM (SELECT w.scene_id, child AS p, b.score + 1e-6 AS lift FROM way w JOIN base b ON b.scene_id = w.scene_id AND b.p = parent
    SEMI JOIN (SELECT scene_id, parent AS p FROM way WHERE iou >= 0.7 GROUP BY ALL HAVING count(*) >= {others}) k ON k.scene_id = w.scene_id AND k.p = child
    WHERE shared >= 0.8 * cs AND cs <= {size} * ps AND cs >= 20{more}) GROUP BY ALL) USING (scene_id, p) WHERE pr >= 0"""


@_query(f"""{_SCORED}, {_children(1)}
SELECT s.scene_id, s.p, round(greatest(CASE WHEN s.score >= {ops.BASE_SCORE} AND u.p IS NULL THEN s.score ELSE -1 END, CASE WHEN c.p IS NULL THEN -1 ELSE greatest(s.score, c.lifted) END), 6) AS priority, u.p IS NOT NULL AS suspect, c.p IS NOT NULL AS admitted
FROM sc s LEFT JOIN (SELECT DISTINCT scene_id, parent AS p FROM split) u USING (scene_id, p) LEFT JOIN (SELECT scene_id, child AS p, max(score) AS lifted FROM split GROUP BY ALL) c USING (scene_id, p)""")
def repair_v1(spark: SparkSession, sf: str) -> DataFrame:
    """Priorities after children have replaced the masks that they make up."""
    found = ops.repair_v1(settled(masks(spark, sf), "masks"), rescored(spark, sf))
    return found.select("scene_id", "p", F.round("priority", 6).alias("priority"), "suspect", "admitted")


@_query(f"{_SCORED}, {_twice(_lifted(0.6, 1, False))}")
def repair_v2(spark: SparkSession, sf: str) -> DataFrame:
    """The assignment after a wide carve-out and the test of what is retained."""
    return ops.repair_v2(settled(masks(spark, sf), "masks"), rescored(spark, sf))


@_query(f"{_SCORED}, {_children(20)}, {_twice(_lifted(0.25, 2, True))}")
def repair_v3(spark: SparkSession, sf: str) -> DataFrame:
    """The assignment after decomposition, a narrow carve-out and the test of what is retained."""
    return ops.repair_v3(settled(masks(spark, sf), "masks"), rescored(spark, sf))


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices as layers of 6 x 10, a decimetre apart."""
    v = F.col("v")
    return masks(spark, sf).select("scene_id", "v").distinct().select("scene_id", "v", (v % 10 / 10).alias("x"), (F.floor(v % 60 / 10) / 10).alias("y"), (F.floor(v / 60) / 10).alias("z"))


#: Least scores of accepted and provisional proposals here.
ACCEPTED, PROVISIONAL = 0.46, 0.44
_STATES = _POLICY.replace("0.48e0", f"{ACCEPTED}e0").replace("0.45e0", f"{PROVISIONAL}e0")
_EXPANDED = f"""WITH {PRELUDE}, {_STATES}
, hard_v AS MATERIALIZED (SELECT scene_id, v, p FROM hard_best SEMI JOIN hard USING (scene_id, p)
), raw AS (SELECT scene_id, p, min(v % 10 / 10) AS x0, max(v % 10 / 10) AS x1, min(v % 60 // 10 / 10) AS y0, max(v % 60 // 10 / 10) AS y1, min(v // 60 / 10) AS z0, max(v // 60 / 10) AS z1 FROM mask GROUP BY ALL
), anchor AS (SELECT r.* FROM raw r JOIN view USING (scene_id, p) WHERE state = 'accepted' AND hard > 0 AND p % 4 = 0
), chosen AS (SELECT DISTINCT c.scene_id, c.p, w.score FROM raw c JOIN view w USING (scene_id, p) JOIN anchor a ON a.scene_id = c.scene_id AND a.x0 <= c.x1 AND c.x0 <= a.x1 AND a.y0 <= c.y1 AND c.y0 <= a.y1
  WHERE state <> 'discarded' AND hard = 0 AND c.z0 - a.z1 BETWEEN -0.03e0 AND 0.02e0 AND (c.z0 + c.z1) / 2 >= a.z1
), claim AS (
  SELECT m.scene_id, m.v, m.p FROM mask m JOIN chosen c USING (scene_id, p) ANTI JOIN (SELECT h.scene_id, h.v FROM hard_v h SEMI JOIN anchor USING (scene_id, p)) k ON k.scene_id = m.scene_id AND k.v = m.v
  QUALIFY row_number() OVER (PARTITION BY m.scene_id, m.v ORDER BY c.score DESC, m.p) = 1
), whole AS (SELECT * FROM claim UNION ALL SELECT h.* FROM hard_v h ANTI JOIN claim c ON c.scene_id = h.scene_id AND c.v = h.v)
SELECT scene_id, p, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, c.p IS NOT NULL AS selected, k.p IS NOT NULL AS anchor
FROM (SELECT scene_id, p, count(*) AS n FROM hard_v GROUP BY ALL) b FULL JOIN (SELECT scene_id, p, count(*) AS n FROM whole GROUP BY ALL HAVING count(*) >= 20) a USING (scene_id, p)
FULL JOIN chosen c USING (scene_id, p) LEFT JOIN anchor k USING (scene_id, p)"""


@_query(_EXPANDED)
def expanded_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Instances before and after proposals that won nothing, but rest on an anchor, claim their vertices."""
    raw = settled(masks(spark, sf), "masks")
    scored = proposals(spark, sf)
    view = settled(m.policy_view(raw, scored, ACCEPTED, PROVISIONAL), "policy")
    hard = settled(m.resolve(raw, scored, ACCEPTED), "hard")
    boxes = settled(ops.raw_boxes(raw, vertices(spark, sf)), "raw-boxes")
    anchors = boxes.join(apart(view.where("state = 'accepted' and hard > 0 and p % 4 = 0")), ["scene_id", "p"], "left_semi")
    candidates = boxes.join(apart(view.where("raw_candidate").select("scene_id", "p", "score")), ["scene_id", "p"])
    # an anchor carries on the top of its box
    tops = anchors.withColumns({"z0": F.col("z1"), "a": F.lit(0.0), "b": F.lit(0.0), "c": F.lit(1.0), "d": -F.col("z1")})
    pairs = settled(footprints_meeting(candidates, tops), "candidates-over-anchors").withColumnRenamed("t", "e")
    chosen = settled(contact.rest_contact(pairs).where("ok").select("scene_id", "e.p", "e.score").distinct(), "chosen")
    after = m.sizes(ops.expanded(hard, raw, chosen, anchors)).withColumnRenamed("size", "after")
    every = m.sizes(hard).withColumnRenamed("size", "before").join(apart(after), ["scene_id", "p"], "full")
    every = every.join(chosen.select("scene_id", "p", F.lit(True).alias("selected")), ["scene_id", "p"], "full").join(apart(anchors.select("scene_id", "p", F.lit(True).alias("anchor"))), ["scene_id", "p"], "left")
    return every.fillna(0, ["before", "after"]).fillna(False, ["selected", "anchor"])
