"""Polygon queries: footprints as diamonds and rectangles, and boxes against panes that are no rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions import polygon as p
from orrery.operators import relations as r
from orrery.plans.scene import PRELUDE, entities, surfaces
from orrery.sources.tables import settled

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _diamond(box: str) -> Column:
    x0, x1, y0, y1 = (g.col(box, k) for k in ("x0", "x1", "y0", "y1"))
    return F.array(p.point(x0, (y0 + y1) / 2), p.point((x0 + x1) / 2, y0), p.point(x1, (y0 + y1) / 2), p.point((x0 + x1) / 2, y1))


def _rectangle(box: str) -> Column:
    x0, x1, y0, y1 = (g.col(box, k) for k in ("x0", "x1", "y0", "y1"))
    return F.array(p.point(x0, y0), p.point(x1, y0), p.point(x1, y1), p.point(x0, y1))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``scene_id, a, b``: the diamond in an entity's footprint, and the footprint of each of the next five."""
    e = settled(entities(spark, sf), "entities")
    one = e.select("scene_id", F.col("uid").alias("a_uid"), F.explode(F.sequence(F.col("ord") + 1, F.col("ord") + 5)).alias("ord"), _diamond("").alias("a"))
    two = e.select("scene_id", "ord", F.col("uid").alias("b_uid"), _rectangle("").alias("b"))
    return one.join(two, ["scene_id", "ord"]).select("scene_id", "a_uid", "b_uid", "a", "b")


#: Corners and sides of the pairs' polygons: k tells the diamond (0) from the rectangle (1).
_SIDES = """q AS (SELECT a.scene_id, a.uid AS a_uid, b.uid AS b_uid, [{'x': a.x0, 'y': (a.y0 + a.y1) / 2}, {'x': (a.x0 + a.x1) / 2, 'y': a.y0}, {'x': a.x1, 'y': (a.y0 + a.y1) / 2}, {'x': (a.x0 + a.x1) / 2, 'y': a.y1}] AS da,
    [{'x': b.x0, 'y': b.y0}, {'x': b.x1, 'y': b.y0}, {'x': b.x1, 'y': b.y1}, {'x': b.x0, 'y': b.y1}] AS rb FROM ent a JOIN ent b ON a.scene_id = b.scene_id AND b.ord BETWEEN a.ord + 1 AND a.ord + 5)"""
_MEASURED = """sd AS (SELECT *, 0 AS k, i, da[i].x AS ax, da[i].y AS ay, da[i % 4 + 1].x AS bx, da[i % 4 + 1].y AS by_ FROM q, range(1, 5) t(i) UNION ALL SELECT *, 1, i, rb[i].x, rb[i].y, rb[i % 4 + 1].x, rb[i % 4 + 1].y FROM q, range(1, 5) t(i)
), m AS (SELECT s.scene_id, s.a_uid, s.b_uid, s.k, s.i, t.i AS j, s.ax AS px, s.ay AS py, s.bx AS qx, s.by_ AS qy, t.ax, t.ay, t.bx, t.by_ FROM sd s JOIN sd t ON s.scene_id = t.scene_id AND s.a_uid = t.a_uid AND s.b_uid = t.b_uid AND s.k <> t.k
), d AS (SELECT *, sqrt((px - ax - u * (bx - ax)) ** 2 + (py - ay - u * (by_ - ay)) ** 2) AS gap FROM (SELECT *, least(greatest(((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2), 0e0), 1e0) AS u FROM m)
), c AS (SELECT *, (bx - ax) * (py - ay) - (by_ - ay) * (px - ax) AS o1, (bx - ax) * (qy - ay) - (by_ - ay) * (qx - ax) AS o2, (qx - px) * (ay - py) - (qy - py) * (ax - px) AS o3, (qx - px) * (by_ - py) - (qy - py) * (bx - px) AS o4 FROM d
), h AS (SELECT scene_id, a_uid, b_uid, k, i, bool_or(o1 = 0 AND px BETWEEN least(ax, bx) AND greatest(ax, bx) AND py BETWEEN least(ay, by_) AND greatest(ay, by_)) OR count(*) FILTER ((ay > py) <> (by_ > py) AND px < (bx - ax) * (py - ay) / nullif(by_ - ay, 0) + ax) % 2 = 1 AS held,
    bool_or(sign(o1) * sign(o2) < 0 AND sign(o3) * sign(o4) < 0) AS crosses, min(gap) AS gap FROM c GROUP BY ALL)"""


@_query(f"WITH {PRELUDE}, {_SIDES}, {_MEASURED} SELECT scene_id, a_uid, b_uid, bool_or(held OR crosses) AS overlaps, round(CASE WHEN bool_or(held OR crosses) THEN 0 ELSE min(gap) END, 6) AS gap FROM h GROUP BY ALL")
def polygon_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Whether two polygons overlap, and how far apart they are."""
    a, b = F.col("a"), F.col("b")
    return pairs(spark, sf).select("scene_id", "a_uid", "b_uid", p.overlap(a, b).alias("overlaps"), F.round(p.distance(a, b), 6).alias("gap"))


@_query(f"""WITH {PRELUDE}, {_SIDES}, n AS (SELECT *, rb[2].x - rb[1].x AS w, (rb[1].x + rb[2].x) / 2 AS mx, (rb[1].y + rb[3].y) / 2 AS my, (da[1].x + da[3].x) / 2 AS cx, da[1].y AS cy, (da[3].x - da[1].x) / 2 AS hx, (da[4].y - da[2].y) / 2 AS hy FROM q
), s AS (SELECT *, 2 * hx * hy AS area_a, w * (rb[3].y - rb[2].y) AS area_b FROM n), t AS (SELECT s.*, greatest(rb[1].x, da[1].x) AS lo, least(rb[2].x, da[3].x) AS hi FROM s
), b AS (SELECT *, list_sort(list_filter([lo, hi, cx, cx - hx * (1 - abs(rb[1].y - cy) / hy), cx + hx * (1 - abs(rb[1].y - cy) / hy), cx - hx * (1 - abs(rb[3].y - cy) / hy), cx + hx * (1 - abs(rb[3].y - cy) / hy)], lambda x: x >= lo AND x <= hi)) AS cuts FROM t
), f AS (SELECT *, list_transform(range(1, len(cuts)), lambda i: (cuts[i + 1] - cuts[i]) * greatest(0e0, least(rb[3].y, cy + hy * (1 - abs((cuts[i] + cuts[i + 1]) / 2 - cx) / hx)) - greatest(rb[1].y, cy - hy * (1 - abs((cuts[i] + cuts[i + 1]) / 2 - cx) / hx)))) AS strips FROM b)
SELECT scene_id, a_uid, b_uid, round(area_a, 9) AS area_a, round(area_b, 9) AS area_b, CASE WHEN hi > lo THEN round(coalesce(list_sum(strips), 0), 5) ELSE 0 END AS shared FROM f""")
def polygon_clip(spark: SparkSession, sf: str) -> DataFrame:
    """Areas of two polygons and of what they share. The SQL integrates between the corners, where the height is linear."""
    a, b = F.col("a"), F.col("b")
    return pairs(spark, sf).select("scene_id", "a_uid", "b_uid", F.round(p.area(a), 9).alias("area_a"), F.round(p.area(b), 9).alias("area_b"), F.round(p.area(p.clip(a, b)), 5).alias("shared"))


@_query(f"""WITH {PRELUDE}, {_SIDES}, k AS (SELECT *, unnest(range(floor(least(da[1].x, rb[1].x) / 0.1e0)::BIGINT, ceil(greatest(da[3].x, rb[2].x) / 0.1e0)::BIGINT + 1)) AS gx FROM q
), l AS (SELECT *, unnest(range(floor(least(da[2].y, rb[1].y) / 0.1e0)::BIGINT, ceil(greatest(da[4].y, rb[3].y) / 0.1e0)::BIGINT + 1)) AS gy FROM k WHERE rb[1].x < da[3].x AND da[1].x < rb[2].x AND rb[1].y < da[4].y AND da[2].y < rb[3].y
), c AS (SELECT scene_id, a_uid, b_uid, abs((gx + 0.5e0) * 0.1e0 - (da[1].x + da[3].x) / 2) / ((da[3].x - da[1].x) / 2) + abs((gy + 0.5e0) * 0.1e0 - da[1].y) / ((da[4].y - da[2].y) / 2) <= 1 AS in_a, (gx + 0.5e0) * 0.1e0 BETWEEN rb[1].x AND rb[2].x AND (gy + 0.5e0) * 0.1e0 BETWEEN rb[1].y AND rb[3].y AS in_b FROM l)
SELECT scene_id, a_uid, b_uid, round(count(*) FILTER (in_a AND in_b) / nullif(count(*) FILTER (in_a OR in_b), 0), 6) AS iou FROM c GROUP BY ALL""")
def polygon_iou(spark: SparkSession, sf: str) -> DataFrame:
    """IoU of polygons whose bounds meet, counted on the middles of a grid of 10 cm cells."""
    cell = 0.1
    low = lambda poly, k: F.array_min(F.transform(poly, lambda q: q[k]))
    high = lambda poly, k: F.array_max(F.transform(poly, lambda q: q[k]))
    both = pairs(spark, sf).where((low("b", "x") < high("a", "x")) & (low("a", "x") < high("b", "x")) & (low("b", "y") < high("a", "y")) & (low("a", "y") < high("b", "y")))
    span = lambda k: F.explode(F.sequence(F.floor(F.least(low("a", k), low("b", k)) / cell), F.ceil(F.greatest(high("a", k), high("b", k)) / cell)))
    cells = both.select("*", span("x").alias("gx")).select("*", span("y").alias("gy"))
    middle = p.point((F.col("gx") + 0.5) * cell, (F.col("gy") + 0.5) * cell)
    held = cells.select("scene_id", "a_uid", "b_uid", p.contains(F.col("a"), middle).alias("in_a"), p.contains(F.col("b"), middle).alias("in_b"))
    counted = held.groupBy("scene_id", "a_uid", "b_uid").agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("n"), F.count_if(F.col("in_a") | F.col("in_b")).alias("m"))
    return counted.select("scene_id", "a_uid", "b_uid", F.round(F.col("n") / F.nullif("m", F.lit(0)), 6).alias("iou"))


#: A pane is the diamond between the middles of a surface's sides, so a box beside its corners is farther than from the rectangle.
_PANES = """w AS (SELECT e.scene_id, e.uid, s.surface, abs(s.a) > 0.5 AS nx, abs(s.b) > 0.5 AS ny, s.a * (e.x0 + e.x1) / 2 + s.b * (e.y0 + e.y1) / 2 + s.c * (e.z0 + e.z1) / 2 + s.d AS mid,
    abs(s.a) * (e.x1 - e.x0) / 2 + abs(s.b) * (e.y1 - e.y0) / 2 + abs(s.c) * (e.z1 - e.z0) / 2 AS reach,
    CASE WHEN abs(s.a) > 0.5 THEN [e.y0, e.y1, e.z0, e.z1, s.y0, s.y1, s.z0, s.z1] WHEN abs(s.b) > 0.5 THEN [e.x0, e.x1, e.z0, e.z1, s.x0, s.x1, s.z0, s.z1] ELSE [e.x0, e.x1, e.y0, e.y1, s.x0, s.x1, s.y0, s.y1] END AS v
  FROM ent e JOIN surf s USING (scene_id)), q AS (SELECT scene_id, uid AS a_uid, surface AS b_uid, mid, reach,
    [{'x': v[5], 'y': (v[7] + v[8]) / 2}, {'x': (v[5] + v[6]) / 2, 'y': v[7]}, {'x': v[6], 'y': (v[7] + v[8]) / 2}, {'x': (v[5] + v[6]) / 2, 'y': v[8]}] AS da, [{'x': v[1], 'y': v[3]}, {'x': v[2], 'y': v[3]}, {'x': v[2], 'y': v[4]}, {'x': v[1], 'y': v[4]}] AS rb FROM w)"""


@_query(f"""WITH {PRELUDE}, {_PANES}, {_MEASURED}, g AS (SELECT scene_id, a_uid AS uid, b_uid AS surface, CASE WHEN bool_or(held OR crosses) THEN 0 ELSE min(gap) END AS gap FROM h GROUP BY ALL),
n AS (SELECT scene_id, a_uid AS uid, b_uid AS surface, CASE WHEN abs(mid) <= reach THEN 0 ELSE abs(mid) - reach END AS away FROM q)
SELECT scene_id, uid, surface, round(gap, 6) AS in_plane_gap, round(sqrt(gap ** 2 + away ** 2), 6) AS distance FROM g JOIN n USING (scene_id, uid, surface)""")
def box_to_pane(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of boxes to polygons on planes: the box's shadow on the plane, its gap to the polygon there, and the plane's own distance."""
    e, s = entities(spark, sf), surfaces(spark, sf)
    axes = {f"{side}{k}": c for side, basis in zip("uv", p.plane_basis(""), strict=True) for k, c in zip(g.AXES, basis, strict=True)}
    met = r.with_surfaces(e, settled(s.withColumns(axes), "planes"))
    basis = tuple([g.col("s", f"{side}{k}") for k in g.AXES] for side in "uv")
    middle = [(g.col("s", f"{k}0") + g.col("s", f"{k}1")) / 2 for k in g.AXES]
    # the two axes that lie in the plane, in order; a corner of the pane is the end of one and the middle of the other
    first = F.abs(F.col("s.a")) > 0.5
    second = F.abs(F.col("s.b")) > 0.5
    along = [[~first, first & F.lit(False), F.lit(False)], [first, ~first & ~second, F.lit(False)], [F.lit(False), first | second, F.lit(False)]]

    def corner(axis: int, end: int) -> Column:
        moved = [F.when(along[i][axis], g.col("s", f"{k}{end}")).otherwise(middle[i]) for i, k in enumerate(g.AXES)]
        return p.on_plane(moved, basis)

    pane = F.array(corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1))
    shaped = met.select("scene_id", F.col("e.uid").alias("uid"), F.col("s.surface").alias("surface"), p.box_shadow("e", basis).alias("shadow"), pane.alias("pane"), g.box_to_plane("e", "s").alias("away"))
    gap = shaped.withColumn("gap", p.distance(F.col("shadow"), F.col("pane")))
    return gap.select("scene_id", "uid", "surface", F.round("gap", 6).alias("in_plane_gap"), F.round(F.hypot("gap", "away"), 6).alias("distance"))


#: Surfaces that are no rectangles: a floor with a corner missing, a sloping triangle, a diamond on a wall; and a wall without a polygon.
SHAPES = (
    ("floor", "floor", 0.0, 0.0, 1.0, 0.0, ((-4.0, -4.0, 0.0), (4.0, -4.0, 0.0), (4.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 4.0, 0.0), (-4.0, 4.0, 0.0))),
    ("ramp", "floor", 0.0, -0.28, 0.96, -2.08, ((-2.0, -4.0, 1.0), (2.0, -4.0, 1.0), (0.0, 0.0, 2.1666666666666665))),
    ("wall_w", "wall", 1.0, 0.0, 0.0, 4.0, ((-4.0, 0.0, 0.0), (-4.0, 4.0, 2.0), (-4.0, 0.0, 4.0), (-4.0, -4.0, 2.0))),
    ("wall_n", "wall", 0.0, -1.0, 0.0, 4.0, None),
)


def shapes(spark: SparkSession, sf: str) -> DataFrame:
    """The shaped surfaces of every scene; their literals are broadcast."""
    schema = "surface string, surface_type string, a double, b double, c double, d double, polygon array<struct<x:double,y:double,z:double>>"
    fixed = spark.createDataFrame(list(SHAPES), schema)
    return entities(spark, sf).select("scene_id").distinct().crossJoin(F.broadcast(fixed))


def _listed(points) -> str:
    return "NULL" if points is None else "[" + ", ".join(f"{{'x': {x}e0, 'y': {y}e0, 'z': {z}e0}}" for x, y, z in points) + "]"


#: The hull of a box's shadow by its sides (all corners on the left), and the polygon's sides; they meet if one holds a corner of the other or sides cross.
_SHAPED = f"""shape AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{k}', {a}e0, {b}e0, {c}e0, {d}e0, {_listed(q)})" for n, k, a, b, c, d, q in SHAPES)}) t(surface, surface_type, a, b, c, d, polygon)
), axis AS (
  SELECT *, CASE WHEN abs(a) <= abs(b) AND abs(a) <= abs(c) THEN [0e0, c, -b] WHEN abs(b) <= abs(c) THEN [-c, 0e0, a] ELSE [b, -a, 0e0] END AS w FROM shape
), based AS (SELECT *, [w[1] / n, w[2] / n, w[3] / n] AS u, [b * w[3] / n - c * w[2] / n, c * w[1] / n - a * w[3] / n, a * w[2] / n - b * w[1] / n] AS v FROM (SELECT *, sqrt(w[1] * w[1] + w[2] * w[2] + w[3] * w[3]) AS n FROM axis)
), met AS (
  SELECT e.scene_id, e.uid, e.cx, e.cy, e.cz, e.x0, e.y0, e.z0, e.x1, e.y1, e.z1, s.*, a * (x0 + x1) / 2 + b * (y0 + y1) / 2 + c * (z0 + z1) / 2 + d AS mid, abs(a) * (x1 - x0) / 2 + abs(b) * (y1 - y0) / 2 + abs(c) * (z1 - z0) / 2 AS reach FROM ent e, based s
), spot AS (
  SELECT scene_id, uid, surface, u, v, polygon, u[1] * px + u[2] * py + u[3] * pz AS sx, v[1] * px + v[2] * py + v[3] * pz AS sy
  FROM (SELECT *, unnest([x0, x0, x0, x0, x1, x1, x1, x1]) AS px, unnest([y0, y0, y1, y1, y0, y0, y1, y1]) AS py, unnest([z0, z1, z0, z1, z0, z1, z0, z1]) AS pz FROM met WHERE polygon IS NOT NULL)
), rim AS MATERIALIZED (
  SELECT s.scene_id, s.uid, s.surface, s.sx AS ax, s.sy AS ay, t.sx AS bx, t.sy AS by_ FROM (SELECT DISTINCT scene_id, uid, surface, sx, sy FROM spot) s JOIN (SELECT DISTINCT scene_id, uid, surface, sx, sy FROM spot) t USING (scene_id, uid, surface) JOIN spot o USING (scene_id, uid, surface)
  WHERE s.sx <> t.sx OR s.sy <> t.sy GROUP BY ALL HAVING bool_and((t.sx - s.sx) * (o.sy - s.sy) - (t.sy - s.sy) * (o.sx - s.sx) > -1e-12)
), pane AS (
  SELECT surface, i, u[1] * polygon[i].x + u[2] * polygon[i].y + u[3] * polygon[i].z AS ax, v[1] * polygon[i].x + v[2] * polygon[i].y + v[3] * polygon[i].z AS ay,
    u[1] * polygon[j].x + u[2] * polygon[j].y + u[3] * polygon[j].z AS bx, v[1] * polygon[j].x + v[2] * polygon[j].y + v[3] * polygon[j].z AS by_
  FROM (SELECT *, i % len(polygon) + 1 AS j FROM (SELECT *, unnest(range(1, len(polygon) + 1)) AS i FROM based WHERE polygon IS NOT NULL))
), pair AS (
  SELECT r.scene_id, r.uid, r.surface, r.ax, r.ay, r.bx, r.by_, p.i, p.ax AS px, p.ay AS py, p.bx AS qx, p.by_ AS qy FROM rim r JOIN pane p USING (surface)
), held AS (
  SELECT scene_id, uid, surface, bool_or(hit) AS hit FROM (
    SELECT scene_id, uid, surface, ax, ay, count(*) FILTER ((py > ay) <> (qy > ay) AND ax < (qx - px) * (ay - py) / nullif(qy - py, 0) + px) % 2 = 1 AS hit FROM (SELECT DISTINCT scene_id, uid, surface, ax, ay, i, px, py, qx, qy FROM pair) GROUP BY ALL
    UNION ALL SELECT scene_id, uid, surface, px, py, bool_and((bx - ax) * (py - ay) - (by_ - ay) * (px - ax) >= 0) FROM pair GROUP BY ALL) GROUP BY ALL
), apart AS (
  SELECT scene_id, uid, surface, bool_or(((bx - ax) * (py - ay) - (by_ - ay) * (px - ax)) * ((bx - ax) * (qy - ay) - (by_ - ay) * (qx - ax)) < 0 AND ((qx - px) * (ay - py) - (qy - py) * (ax - px)) * ((qx - px) * (by_ - py) - (qy - py) * (bx - px)) < 0) AS crosses,
    min(least(sqrt((ax - px - t * (qx - px)) ** 2 + (ay - py - t * (qy - py)) ** 2), sqrt((px - ax - s * (bx - ax)) ** 2 + (py - ay - s * (by_ - ay)) ** 2))) AS gap
  FROM (SELECT *, greatest(0e0, least(1e0, ((ax - px) * (qx - px) + (ay - py) * (qy - py)) / ((qx - px) ** 2 + (qy - py) ** 2))) AS t, greatest(0e0, least(1e0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) AS s FROM pair) GROUP BY ALL
), surfaced AS MATERIALIZED (
  SELECT m.scene_id, m.uid, m.surface, surface_type, c, a * cx + b * cy + c * cz + d AS side, mid - reach AS low, CASE WHEN abs(mid) <= reach THEN 0 ELSE abs(mid) - reach END AS normal_gap,
    CASE WHEN polygon IS NULL THEN NULL WHEN hit OR crosses THEN 0 ELSE gap END AS plane_gap
  FROM met m LEFT JOIN held h ON h.scene_id = m.scene_id AND h.uid = m.uid AND h.surface = m.surface LEFT JOIN apart p ON p.scene_id = m.scene_id AND p.uid = m.uid AND p.surface = m.surface
)"""


@_query(f"""WITH {PRELUDE}, {_SHAPED} SELECT scene_id, uid, surface, round(CASE WHEN plane_gap IS NULL THEN normal_gap ELSE sqrt(normal_gap ** 2 + plane_gap ** 2) END, 6) AS distance, CASE WHEN plane_gap IS NULL THEN 'bbox_to_plane' ELSE 'polygon_clipped' END AS distance_metric,
  round(normal_gap, 6) AS normal_gap, round(plane_gap, 6) AS in_plane_gap, CASE WHEN plane_gap IS NULL THEN 'polygon_none' END AS fallback_reason FROM surfaced""")
def box_to_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of boxes to surfaces of any shape, with the reason where only the plane counts."""
    met = r.with_surfaces(entities(spark, sf), shapes(spark, sf)).withColumn("m", p.box_to_surface("e", "s"))
    six = [F.round(f"m.{k}", 6).alias(k) for k in ("distance", "normal_gap", "in_plane_gap")]
    return met.select("scene_id", F.col("e.uid").alias("uid"), F.col("s.surface").alias("surface"), *six, "m.distance_metric", "m.fallback_reason")


_NEAR = " ".join(f"WHEN '{k}' THEN {v}" for k, v in r.NEAR_SURFACE.items())


@_query(f"""WITH {PRELUDE}, {_SHAPED} SELECT scene_id, uid AS src, surface AS dst, round(distance, 6) AS metric FROM (SELECT *, CASE WHEN plane_gap IS NULL THEN normal_gap ELSE sqrt(normal_gap ** 2 + plane_gap ** 2) END AS distance FROM surfaced)
WHERE distance <= CASE surface_type {_NEAR} END""")
def near_surface_polygon(spark: SparkSession, sf: str) -> DataFrame:
    """NEAR_SURFACE over surfaces of any shape."""
    found = r.near_surface(entities(spark, sf), shapes(spark, sf), polygons=True)
    return found.select("scene_id", "src", "dst", F.round("metric", 6).alias("metric"))


@_query(f"""WITH {PRELUDE}, {_SHAPED} SELECT scene_id, uid AS src, surface AS dst, 'ON_SURFACE' AS type, round(low, 6) AS metric, array_to_string(failed, ',') AS failed FROM (SELECT *, list_filter([CASE WHEN c < cos(radians(30)) THEN 'support_capable' END, CASE WHEN side < 0 THEN 'centroid_on_support_side' END,
  CASE WHEN NOT low BETWEEN -0.03 AND 0.02 THEN 'contact' END, CASE WHEN plane_gap > 0 THEN 'footprint_ok' END], lambda x: x IS NOT NULL) AS failed FROM surfaced WHERE plane_gap IS NOT NULL)
UNION ALL SELECT scene_id, uid, surface, 'CONTACTS_SURFACE', round(low, 6), array_to_string(failed, ',') FROM (SELECT *, list_filter([CASE WHEN abs(c) > sin(radians(30)) THEN 'wall_capable' END, CASE WHEN side < 0 THEN 'centroid_on_support_side' END,
  CASE WHEN NOT low BETWEEN -0.02 AND 0.02 THEN 'contact' END, CASE WHEN plane_gap > 0 THEN 'footprint_ok' END], lambda x: x IS NOT NULL) AS failed FROM surfaced WHERE plane_gap IS NOT NULL AND surface_type = 'wall')""")
def polygon_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Rest and wall contacts with surfaces of any shape, and the clauses that fail."""
    e, s = entities(spark, sf), shapes(spark, sf)
    tests = r.on_surface_tests(e, s).unionByName(r.contacts_surface_tests(e, s))
    return tests.select("scene_id", "src", "dst", "type", F.round("metric", 6).alias("metric"), F.array_join("failed", ",").alias("failed"))
