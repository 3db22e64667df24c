"""Association of the view masks of ``plans.masks`` across views, votes on vertices, and proposals beside a bank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import association as ops
from orrery.plans.masks import PRELUDE, masks, proposals, view_masks, visible
from orrery.sources.tables import settled

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Limits that suit masks of 20 to 220 vertices; views are five degrees apart.
LINK = ops.Linkage(stride=4, iou=0.6, contained=0.9, ratio=0.75)
VOTE = ops.Voting(member_iou=0.5, least=20, most_share=0.4)
NEW = ops.Novelty(duplicate=0.65, split=0.65, size=0.9, least=20, most=12)
DEGREES = 5.0


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_CLUSTERS = f"""WITH RECURSIVE {PRELUDE}, lift AS MATERIALIZED (SELECT scene_id, mask, view, v FROM views
), anchored AS (SELECT scene_id, mask, view, v FROM lift WHERE v % {LINK.stride} = 0
), asize AS (SELECT scene_id, mask, count(*) AS n FROM anchored GROUP BY ALL
), apair AS (SELECT a.scene_id, a.mask AS p, b.mask AS q, count(*) AS shared FROM anchored a JOIN anchored b USING (scene_id, v) WHERE a.mask < b.mask AND a.view <> b.view GROUP BY ALL
), link AS (
  SELECT l.scene_id, p, q FROM apair l JOIN asize a ON a.scene_id = l.scene_id AND a.mask = p JOIN asize b ON b.scene_id = l.scene_id AND b.mask = q
  WHERE shared / (a.n + b.n - shared) >= {LINK.iou} OR (shared / least(a.n, b.n) >= {LINK.contained} AND least(a.n, b.n) / greatest(a.n, b.n) >= {LINK.ratio})
), both_ AS MATERIALIZED (SELECT scene_id, p, q FROM link UNION ALL SELECT scene_id, q, p FROM link
), reach AS (SELECT DISTINCT scene_id, mask AS p, mask AS q FROM lift UNION SELECT r.scene_id, r.p, b.q FROM reach r JOIN both_ b ON b.scene_id = r.scene_id AND b.p = r.q
), member AS MATERIALIZED (SELECT scene_id, p AS mask, p % 8 AS view, min(q) AS cluster FROM reach GROUP BY ALL)"""


def lifted(spark: SparkSession, sf: str) -> DataFrame:
    return view_masks(spark, sf).select("scene_id", "mask", "view", "v")


@_query(f"{_CLUSTERS} SELECT scene_id, mask, view, cluster FROM member")
def view_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The cluster of every view's mask."""
    return ops.associated(settled(lifted(spark, sf), "lifted"), LINK)


def _spread(t: str, members: str) -> str:
    return f"""{t}_v AS (SELECT DISTINCT scene_id, cluster, view FROM {members}
), {t} AS (
  SELECT a.scene_id, a.cluster, count(DISTINCT a.view) AS views, CASE WHEN count(DISTINCT a.view) > 1 THEN degrees(acos(greatest(-1e0, least(1e0, min(cos(radians({DEGREES} * a.view)) * cos(radians({DEGREES} * b.view)) + sin(radians({DEGREES} * a.view)) * sin(radians({DEGREES} * b.view))))))) ELSE 0 END AS degrees
  FROM {t}_v a JOIN {t}_v b USING (scene_id, cluster) GROUP BY ALL)"""


def _vote(t: str, members: str) -> str:
    return f"""{t} AS MATERIALIZED (
  SELECT h.scene_id, h.cluster, h.v FROM (SELECT scene_id, cluster, v, count(*) AS held FROM {members} JOIN lift USING (scene_id, mask) GROUP BY ALL) h
  LEFT JOIN (SELECT m.scene_id, m.cluster, s.v, count(*) AS could FROM (SELECT DISTINCT scene_id, cluster, view FROM {members}) m JOIN seen s ON s.scene_id = m.scene_id AND s.view = m.view GROUP BY ALL) c
    ON c.scene_id = h.scene_id AND c.cluster = h.cluster AND c.v = h.v WHERE held / greatest(coalesce(could, 0), 1) >= {VOTE.share})"""


_FUSED = f"""{_CLUSTERS}, {_spread('wide', 'member')}
, able AS (SELECT m.* FROM member m JOIN wide USING (scene_id, cluster) WHERE views >= {VOTE.views} AND degrees >= {VOTE.degrees}
), {_vote('first', 'able')}
, fsize AS (SELECT scene_id, cluster, count(*) AS size FROM first GROUP BY ALL HAVING count(*) >= {VOTE.least}
), lsize AS (SELECT scene_id, mask, count(*) AS own FROM lift GROUP BY ALL
), stay AS MATERIALIZED (
  SELECT m.scene_id, m.cluster, m.mask, m.view FROM able m JOIN lift l ON l.scene_id = m.scene_id AND l.mask = m.mask JOIN first f ON f.scene_id = m.scene_id AND f.cluster = m.cluster AND f.v = l.v
  JOIN fsize s ON s.scene_id = m.scene_id AND s.cluster = m.cluster JOIN lsize o ON o.scene_id = m.scene_id AND o.mask = m.mask
  GROUP BY m.scene_id, m.cluster, m.mask, m.view, size, own HAVING count(*) / (own + size - count(*)) >= {VOTE.member_iou}
), counted AS (
  SELECT s.*, b.n AS before FROM (SELECT scene_id, cluster, count(*) AS members, count(DISTINCT view) AS left_ FROM stay GROUP BY ALL) s JOIN (SELECT scene_id, cluster, count(*) AS n FROM able GROUP BY ALL) b USING (scene_id, cluster) WHERE left_ >= {VOTE.views}
), torn AS (SELECT s.* FROM stay s JOIN counted USING (scene_id, cluster) WHERE members < before
), {_vote('again', 'torn')}
, whole AS (SELECT f.* FROM first f JOIN counted USING (scene_id, cluster) WHERE members = before UNION ALL SELECT * FROM again
), {_spread('narrow', 'stay')}
, fused AS MATERIALIZED (
  SELECT w.scene_id, w.cluster, members, views, degrees, confidence, w.size FROM (SELECT scene_id, cluster, count(*) AS size FROM whole GROUP BY ALL HAVING count(*) >= {VOTE.least}) w
  JOIN (SELECT scene_id, count(DISTINCT v) AS n FROM mask GROUP BY ALL) USING (scene_id) JOIN counted USING (scene_id, cluster) JOIN narrow USING (scene_id, cluster)
  JOIN (SELECT s.scene_id, cluster, avg(score) AS confidence FROM stay s JOIN prop x ON x.scene_id = s.scene_id AND x.p = s.mask GROUP BY ALL) c USING (scene_id, cluster)
  WHERE w.size <= {VOTE.most_share} * n AND views >= {VOTE.views} AND degrees >= {VOTE.degrees}
), held AS MATERIALIZED (SELECT w.* FROM whole w SEMI JOIN fused USING (scene_id, cluster))"""


def _fused(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    raw = settled(masks(spark, sf), "masks")
    own = settled(view_masks(spark, sf, raw).select("scene_id", "mask", "view", "v"), "lifted")
    angle = F.radians(F.lit(DEGREES) * F.col("view"))
    directions = own.select("scene_id", "view").distinct().select("scene_id", "view", F.cos(angle).alias("dx"), F.sin(angle).alias("dy"), F.lit(0.0).alias("dz"))
    quality = proposals(spark, sf).select("scene_id", F.col("p").alias("mask"), F.col("score").alias("predicted"))
    total = raw.groupBy("scene_id").agg(F.count_distinct("v").alias("n"))
    clusters = settled(ops.associated(own, LINK), "clusters")
    found, held = ops.fused(clusters, own, visible(spark, sf, raw), directions, quality, total, VOTE)
    return raw, found, held


@_query(f"{_FUSED} SELECT scene_id, cluster, members, views, round(degrees, 4) AS degrees, round(confidence, 6) AS confidence, f.size, min(v) AS first_v, max(v) AS last_v FROM fused f JOIN held USING (scene_id, cluster) GROUP BY ALL")
def cluster_votes(spark: SparkSession, sf: str) -> DataFrame:
    """What clusters with support from enough views vote for."""
    _, found, held = _fused(spark, sf)
    ends = held.groupBy("scene_id", "cluster").agg(F.min("v").alias("first_v"), F.max("v").alias("last_v"))
    return found.join(ends, ["scene_id", "cluster"]).withColumns({"degrees": F.round("degrees", 4), "confidence": F.round("confidence", 6)})


@_query(f"""{_FUSED}
, bank AS MATERIALIZED (SELECT scene_id, p, v FROM mask WHERE p % 7 = 0
), bsize AS (SELECT scene_id, p, count(*) AS psize FROM bank GROUP BY ALL
), bpair AS (SELECT h.scene_id, h.cluster, b.p, count(*) AS shared FROM held h JOIN bank b USING (scene_id, v) GROUP BY ALL
), near AS (SELECT b.scene_id, b.cluster, arg_min(b.p, -shared * 1000000 + b.p) AS parent, max(shared) AS shared, max(shared / (f.size + psize - shared)) AS iou FROM bpair b JOIN bsize USING (scene_id, p) JOIN fused f USING (scene_id, cluster) GROUP BY ALL
), kinds AS MATERIALIZED (
  SELECT f.scene_id, f.cluster, confidence, f.size, parent, coalesce(shared, 0) AS shared, coalesce(iou, 0) AS iou, coalesce(shared, 0) / f.size AS containment,
    CASE WHEN coalesce(iou, 0) >= {NEW.duplicate} THEN 'duplicate_of_baseline' WHEN coalesce(shared, 0) / f.size < {NEW.additional} THEN 'additional'
      WHEN shared / f.size < {NEW.split} OR f.size > {NEW.size} * psize THEN 'ambiguous_containment' WHEN shared < {NEW.least} THEN 'split_piece_too_small' ELSE 'split' END AS kind
  FROM fused f LEFT JOIN near n ON n.scene_id = f.scene_id AND n.cluster = f.cluster LEFT JOIN bsize b ON b.scene_id = f.scene_id AND b.p = parent
), piece AS MATERIALIZED (
  SELECT h.scene_id, h.cluster, h.v FROM held h JOIN kinds k USING (scene_id, cluster) WHERE kind = 'additional' OR (kind = 'split' AND EXISTS (SELECT 1 FROM bank b WHERE b.scene_id = h.scene_id AND b.p = parent AND b.v = h.v))
), ranked AS MATERIALIZED (
  SELECT scene_id, cluster, n, row_number() OVER (PARTITION BY scene_id ORDER BY confidence DESC, n DESC, start, cluster) AS place, vs FROM (SELECT scene_id, cluster, count(*) AS n, min(v) AS start, list(v) AS vs FROM piece GROUP BY ALL) JOIN kinds USING (scene_id, cluster)
), rival AS (
  SELECT a.scene_id, a.place, list(b.place) AS others FROM ranked a JOIN ranked b ON a.scene_id = b.scene_id AND a.place <> b.place AND len(list_intersect(a.vs, b.vs)) / (a.n + b.n - len(list_intersect(a.vs, b.vs))) >= {NEW.duplicate} GROUP BY ALL
), walk AS (
  SELECT scene_id, 0::BIGINT AS place, FALSE AS repeated, []::BIGINT[] AS kept FROM (SELECT DISTINCT scene_id FROM ranked)
  UNION ALL SELECT w.scene_id, r.place, list_has_any(kept, coalesce(others, [])), CASE WHEN list_has_any(kept, coalesce(others, [])) THEN kept ELSE list_append(kept, r.place) END
  FROM walk w JOIN ranked r ON r.scene_id = w.scene_id AND r.place = w.place + 1 LEFT JOIN rival o ON o.scene_id = r.scene_id AND o.place = r.place
)
SELECT k.scene_id, k.cluster, CASE WHEN w.repeated THEN 'duplicate_repair' ELSE kind END AS kind, CASE WHEN kind = 'split' THEN parent END AS parent, round(containment, 6) AS containment, round(iou, 6) AS iou, coalesce(r.n, k.size) AS size,
  coalesce(NOT w.repeated AND len(w.kept) <= {NEW.most}, FALSE) AS emitted
FROM kinds k LEFT JOIN ranked r ON r.scene_id = k.scene_id AND r.cluster = k.cluster LEFT JOIN walk w ON w.scene_id = r.scene_id AND w.place = r.place""")
def cluster_novelty(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a fused proposal adds to a bank, splits one of its masks or repeats it, and whether it is emitted."""
    raw, found, held = _fused(spark, sf)
    told = ops.classified(found, held, raw.where("p % 7 = 0"), NEW)
    return told.withColumns({"containment": F.round("containment", 6), "iou": F.round("iou", 6)})
