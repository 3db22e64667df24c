"""Horizontal patches of a scene's meshes, its floor, and what rests on what.

Every entity of ``plans.scene`` becomes a mesh: its top is a grid of 3 x 3 squares, level, tilted,
bumpy or in two steps by its number, over four sides; a floor of 4 x 4 squares is one more
instance. Some vertices belong to no instance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.digests import ids_sha256_sql
from orrery.operators import patches as ops
from orrery.plans.scene import PRELUDE, entities
from orrery.sources.tables import settled

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Instances of floors, numbers of vertices and of faces that an instance may have.
FLOOR, VERTICES, FACES = 1_000_000_000, 32, 64
#: Corners of the four sides: places in the top's grid, and in the ring below.
RING, BASE = (0, 12, 15, 3), (16, 17, 18, 19)


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH RECURSIVE {PRELUDE}, {sql}"
        return f

    return add


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """``scene_id, owner, uid`` and the box of every entity and floor."""
    ends = [f"{k}{n}" for n in (0, 1) for k in "xyz"]
    own = entities(spark, sf).select("scene_id", F.col("ord").alias("owner"), "uid", *ends)
    flat = [F.lit(v).alias(k) for k, v in zip(ends, (-6.0, -6.0, 0.0, 6.0, 6.0, 0.0), strict=True)]
    floors = own.select("scene_id").distinct().select("scene_id", (F.col("scene_id") + FLOOR).alias("owner"), F.concat(F.lit("floor_"), F.col("scene_id").cast("string")).alias("uid"), *flat)
    return own.unionByName(floors)


def _places(n: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(n) for j in range(n)]))


def scene_mesh(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boxes, faces (scene_id, fid, a, b, c) and vertices (scene_id, vid, x, y, z, instance)."""
    every = settled(boxes(spark, sf), "mesh-boxes")
    own, floors = every.where(F.col("owner") < FLOOR), every.where(F.col("owner") >= FLOOR)
    top = own.select("*", _places(4).alias("p")).select("*", "p.i", "p.j")
    o, w = F.col("owner"), {k: F.col(f"{k}1") - F.col(f"{k}0") for k in "xyz"}
    x, y = F.col("x0") + w["x"] * F.col("i") / 3, F.col("y0") + w["y"] * F.col("j") / 3
    slope = F.when(o % 4 == 1, 0.1).when(o % 4 == 2, 0.4).otherwise(0.0)
    inner = F.col("i").between(1, 2) & F.col("j").between(1, 2)
    diagonal = F.sqrt(w["x"] * w["x"] + w["y"] * w["y"] + w["z"] * w["z"])
    bump = F.when((o % 5 == 4) & inner, 0.03 * diagonal * ((F.col("i") + F.col("j")) % 2)).otherwise(0.0)
    step = F.when((o % 6 == 5) & (F.col("i") >= 2), 0.3 * w["z"]).otherwise(0.0)
    k = F.col("i") * 4 + F.col("j")
    held = F.when((o % 9 == 0) & (k == 0), -1).otherwise(o).cast("long").alias("instance")
    tops = top.select("scene_id", (o * VERTICES + k).alias("vid"), x.alias("x"), y.alias("y"), (F.col("z1") + slope * (x - (F.col("x0") + F.col("x1")) / 2) + bump - step).alias("z"), held)
    ring = F.explode(F.array(*[F.struct(F.lit(b).alias("k"), F.col(f"x{m}").alias("x"), F.col(f"y{n}").alias("y")) for b, (m, n) in zip(BASE, ((0, 0), (1, 0), (1, 1), (0, 1)), strict=True)]))
    below = own.select("scene_id", "owner", "z0", ring.alias("r")).select("scene_id", (o * VERTICES + F.col("r.k")).alias("vid"), "r.x", "r.y", F.col("z0").alias("z"), o.alias("instance"))
    ground = floors.select("scene_id", "owner", _places(5).alias("p")).select("scene_id", (o * VERTICES + F.col("p.i") * 5 + F.col("p.j")).alias("vid"), (F.col("p.i") * 3.0 - 6).alias("x"), (F.col("p.j") * 3.0 - 6).alias("y"), F.lit(0.0).alias("z"), o.alias("instance"))

    def squares(df: DataFrame, n: int) -> DataFrame:
        at = df.select("scene_id", "owner", _places(n).alias("p"))
        v, f = o * VERTICES + F.col("p.i") * (n + 1) + F.col("p.j"), o * FACES + 2 * (F.col("p.i") * n + F.col("p.j"))
        made = F.array(*[F.struct((f + t).alias("fid"), *[(v + d).alias(c) for c, d in zip("abc", ds, strict=True)]) for t, ds in enumerate(((0, n + 1, 1), (1, n + 1, n + 2)))])
        return at.select("scene_id", F.explode(made).alias("f")).select("scene_id", "f.*")

    halves = [(RING[s], RING[(s + 1) % 4], BASE[s]) for s in range(4)] + [(RING[(s + 1) % 4], BASE[(s + 1) % 4], BASE[s]) for s in range(4)]
    side = F.explode(F.array(*[F.struct((o * FACES + 18 + t).alias("fid"), *[(o * VERTICES + d).alias(c) for c, d in zip("abc", ds, strict=True)]) for t, ds in enumerate(halves)]))
    faces = squares(own, 3).unionByName(squares(floors, 4)).unionByName(own.select("scene_id", side.alias("f")).select("scene_id", "f.*"))
    return every, faces, tops.unionByName(below).unionByName(ground)


_HALVES = [(RING[s], RING[(s + 1) % 4], BASE[s]) for s in range(4)] + [(RING[(s + 1) % 4], BASE[(s + 1) % 4], BASE[s]) for s in range(4)]
#: The same meshes in SQL.
MESHES = f"""
box AS (
  SELECT scene_id, ord AS owner, uid, x0, y0, z0, x1, y1, z1 FROM ent
  UNION ALL SELECT DISTINCT scene_id, scene_id + {FLOOR}, 'floor_' || scene_id, -6e0, -6e0, 0e0, 6e0, 6e0, 0e0 FROM ent
), topv AS (
  SELECT *, i * 4 + j AS k, x0 + (x1 - x0) * i / 3 AS x, y0 + (y1 - y0) * j / 3 AS y FROM box, range(4) a(i), range(4) b(j) WHERE owner < {FLOOR}
), vert AS MATERIALIZED (
  SELECT scene_id, owner * {VERTICES} + k AS vid, x, y,
    z1 + CASE owner % 4 WHEN 1 THEN 0.1e0 WHEN 2 THEN 0.4e0 ELSE 0 END * (x - (x0 + x1) / 2)
      + CASE WHEN owner % 5 = 4 AND i BETWEEN 1 AND 2 AND j BETWEEN 1 AND 2 THEN 0.03e0 * sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) + (z1 - z0) * (z1 - z0)) * ((i + j) % 2) ELSE 0 END
      - CASE WHEN owner % 6 = 5 AND i >= 2 THEN 0.3e0 * (z1 - z0) ELSE 0 END AS z,
    CASE WHEN owner % 9 = 0 AND k = 0 THEN -1 ELSE owner END AS instance FROM topv
  UNION ALL SELECT scene_id, owner * {VERTICES} + {BASE[0]} + n, CASE WHEN n IN (0, 3) THEN x0 ELSE x1 END, CASE WHEN n < 2 THEN y0 ELSE y1 END, z0, owner FROM box, range(4) r(n) WHERE owner < {FLOOR}
  UNION ALL SELECT scene_id, owner * {VERTICES} + i * 5 + j, i * 3e0 - 6, j * 3e0 - 6, 0e0, owner FROM box, range(5) a(i), range(5) b(j) WHERE owner >= {FLOOR}
), square AS (
  SELECT scene_id, owner, i, j, 3 AS n FROM box, range(3) a(i), range(3) b(j) WHERE owner < {FLOOR}
  UNION ALL SELECT scene_id, owner, i, j, 4 FROM box, range(4) a(i), range(4) b(j) WHERE owner >= {FLOOR}
), cornered AS (SELECT scene_id, owner * {VERTICES} + i * (n + 1) + j AS v, owner * {FACES} + 2 * (i * n + j) AS f, n FROM square
), face AS (
  SELECT scene_id, f AS fid, v AS a, v + n + 1 AS b, v + 1 AS c FROM cornered UNION ALL SELECT scene_id, f + 1, v + 1, v + n + 1, v + n + 2 FROM cornered
  UNION ALL SELECT scene_id, owner * {FACES} + 18 + t, owner * {VERTICES} + p, owner * {VERTICES} + q, owner * {VERTICES} + r
    FROM box, (VALUES {", ".join(f"({t}, {p}, {q}, {r})" for t, (p, q, r) in enumerate(_HALVES))}) h(t, p, q, r) WHERE owner < {FLOOR}
)"""
_L = ops.PatchLimits()
_PATCHES = f"""{MESHES}
, own AS (
  SELECT scene_id, instance AS owner, count(*) AS n_assigned, max(x) - min(x) AS wx, max(y) - min(y) AS wy, max(z) - min(z) AS wz FROM vert WHERE instance >= 0 GROUP BY ALL
), tri AS (
  SELECT f.scene_id, p.instance AS owner, fid, a, b, c, p AS pa, q AS pb, r AS pc,
    (q.y - p.y) * (r.z - p.z) - (q.z - p.z) * (r.y - p.y) AS kx, (q.z - p.z) * (r.x - p.x) - (q.x - p.x) * (r.z - p.z) AS ky, (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) AS kz
  FROM face f JOIN vert p ON p.scene_id = f.scene_id AND p.vid = a JOIN vert q ON q.scene_id = f.scene_id AND q.vid = b JOIN vert r ON r.scene_id = f.scene_id AND r.vid = c
  WHERE p.instance = q.instance AND q.instance = r.instance AND p.instance >= 0
), flat AS MATERIALIZED (
  SELECT *, sqrt(kx * kx + ky * ky + kz * kz) AS twice FROM tri WHERE abs(kz) >= cos(radians({_L.angle})) * sqrt(kx * kx + ky * ky + kz * kz) AND kx * kx + ky * ky + kz * kz > 0
), edge AS (SELECT scene_id, owner, fid, least(p, q) AS lo, greatest(p, q) AS hi FROM (SELECT scene_id, owner, fid, unnest([a, b, c]) AS p, unnest([b, c, a]) AS q FROM flat)
), adjacent AS MATERIALIZED (SELECT DISTINCT e.scene_id, e.owner, e.fid AS f, d.fid AS g FROM edge e JOIN edge d USING (scene_id, owner, lo, hi)
), reach AS (SELECT scene_id, owner, fid AS f, fid AS g FROM flat UNION SELECT r.scene_id, r.owner, r.f, a.g FROM reach r JOIN adjacent a ON a.scene_id = r.scene_id AND a.owner = r.owner AND a.f = r.g
), comp AS MATERIALIZED (
  SELECT f.*, root FROM flat f JOIN (SELECT scene_id, owner, f AS fid, min(g) AS root FROM reach GROUP BY ALL) USING (scene_id, owner, fid)
  QUALIFY count(*) OVER (PARTITION BY scene_id, owner, root) >= {_L.faces}
), corner AS MATERIALIZED (SELECT scene_id, owner, root, twice / 6 AS w, unnest([pa, pb, pc]) AS p FROM comp
), mean AS (SELECT scene_id, owner, root, sum(w * p.x) / sum(w) AS mx, sum(w * p.y) / sum(w) AS my, sum(w * p.z) / sum(w) AS mz FROM corner GROUP BY ALL
), cov AS (
  SELECT scene_id, owner, root, mx, my, mz, sum(w * (p.x - mx) * (p.x - mx)) / sum(w) AS xx, sum(w * (p.x - mx) * (p.y - my)) / sum(w) AS xy, sum(w * (p.x - mx) * (p.z - mz)) / sum(w) AS xz,
    sum(w * (p.y - my) * (p.y - my)) / sum(w) AS yy, sum(w * (p.y - my) * (p.z - mz)) / sum(w) AS yz, sum(w * (p.z - mz) * (p.z - mz)) / sum(w) AS zz
  FROM corner JOIN mean USING (scene_id, owner, root) GROUP BY ALL
), cubic AS (SELECT *, (xx + yy + zz) / 3 AS q, sqrt(((xx - yy) ** 2 + (yy - zz) ** 2 + (zz - xx) ** 2 + 6 * (xy * xy + xz * xz + yz * yz)) / 18) AS s FROM cov
), eigen AS (
  SELECT *, q + 2 * s * cos(acos(greatest(-1e0, least(1e0, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * s * s * s)))) / 3 + 2 * pi() / 3) AS l FROM cubic
), axes AS (
  SELECT *, xy * yz - xz * (yy - l) AS ax, xz * xy - (xx - l) * yz AS ay, (xx - l) * (yy - l) - xy * xy AS az,
    (yy - l) * (zz - l) - yz * yz AS bx, yz * xz - xy * (zz - l) AS by_, xy * yz - (yy - l) * xz AS bz,
    yz * xz - (zz - l) * xy AS cx, (zz - l) * (xx - l) - xz * xz AS cy, xz * xy - yz * (xx - l) AS cz FROM eigen
), chosen AS (
  SELECT *, list_max([{{'n': sqrt(ax * ax + ay * ay + az * az), 'x': ax, 'y': ay, 'z': az}}, {{'n': sqrt(bx * bx + by_ * by_ + bz * bz), 'x': bx, 'y': by_, 'z': bz}}, {{'n': sqrt(cx * cx + cy * cy + cz * cz), 'x': cx, 'y': cy, 'z': cz}}]) AS v FROM axes
), plane AS MATERIALIZED (
  SELECT scene_id, owner, root, mx, my, mz, sqrt(greatest(l, 0)) AS rough, v.x / v.n * sgn AS px, v.y / v.n * sgn AS py, v.z / v.n * sgn AS pz FROM (SELECT *, CASE WHEN v.z < 0 THEN -1 ELSE 1 END AS sgn FROM chosen)
), summed AS (
  SELECT scene_id, owner, root, sum(twice / 2) AS mesh_area, sum(abs(kx * px + ky * py + kz * pz) / 2) AS projected_area, count(*) AS n_faces, {ids_sha256_sql("list(fid ORDER BY fid)")} AS digest FROM comp JOIN plane USING (scene_id, owner, root) GROUP BY ALL
), base AS (
  SELECT *, CASE WHEN abs(px) > 0.9e0 THEN 0e0 - px * py ELSE 1 - px * px END AS fx, CASE WHEN abs(px) > 0.9e0 THEN 1 - py * py ELSE 0e0 - py * px END AS fy, CASE WHEN abs(px) > 0.9e0 THEN 0e0 - pz * py ELSE 0e0 - pz * px END AS fz FROM plane
), basis AS (SELECT *, fx / sqrt(fx * fx + fy * fy + fz * fz) AS ux, fy / sqrt(fx * fx + fy * fy + fz * fz) AS uy, fz / sqrt(fx * fx + fy * fy + fz * fz) AS uz FROM base
), spot AS MATERIALIZED (
  SELECT scene_id, owner, root, px, py, pz, p.vid, (p.x - mx) * ux + (p.y - my) * uy + (p.z - mz) * uz AS lx, (p.x - mx) * (py * uz - pz * uy) + (p.y - my) * (pz * ux - px * uz) + (p.z - mz) * (px * uy - py * ux) AS ly,
    mx, my, ux, uy, py * uz - pz * uy AS vx, pz * ux - px * uz AS vy
  FROM (SELECT DISTINCT scene_id, owner, root, p FROM corner) JOIN basis USING (scene_id, owner, root)
), side AS MATERIALIZED (
  SELECT s.scene_id, s.owner, s.root, s.vid AS v, t.vid AS w, s.lx AS sx, s.ly AS sy, t.lx AS tx, t.ly AS ty,
    s.mx + s.lx * s.ux + s.ly * s.vx AS gx, s.my + s.lx * s.uy + s.ly * s.vy AS gy, t.mx + t.lx * t.ux + t.ly * t.vx AS hx, t.my + t.lx * t.uy + t.ly * t.vy AS hy
  FROM spot s JOIN spot t ON t.scene_id = s.scene_id AND t.owner = s.owner AND t.root = s.root AND t.vid <> s.vid
  JOIN spot o ON o.scene_id = s.scene_id AND o.owner = s.owner AND o.root = s.root GROUP BY ALL
  HAVING bool_and((t.lx - s.lx) * (o.ly - s.ly) - (t.ly - s.ly) * (o.lx - s.lx) > -1e-9
    AND (abs((t.lx - s.lx) * (o.ly - s.ly) - (t.ly - s.ly) * (o.lx - s.lx)) > 1e-9 OR (o.lx - s.lx) * (t.lx - s.lx) + (o.ly - s.ly) * (t.ly - s.ly) BETWEEN -1e-9 AND (t.lx - s.lx) ** 2 + (t.ly - s.ly) ** 2 + 1e-9))
), hull AS (SELECT scene_id, owner, root, sum(sx * ty - sy * tx) / 2 AS footprint_area FROM side GROUP BY ALL
), many AS (SELECT scene_id, owner, root, count(*) AS n_vertices FROM spot GROUP BY ALL
), measured AS (
  SELECT *, sqrt(wx * wx + wy * wy + wz * wz) AS owner_diagonal, projected_area / (wx * wy) AS area_share, projected_area / footprint_area AS coverage, degrees(acos(greatest(-1e0, least(1e0, pz)))) AS tilt, -(px * mx + py * my + pz * mz) AS d
  FROM plane JOIN summed USING (scene_id, owner, root) JOIN hull USING (scene_id, owner, root) JOIN many USING (scene_id, owner, root) JOIN own USING (scene_id, owner)
), patch AS MATERIALIZED (
  SELECT *, rough / owner_diagonal AS roughness_ratio, format('instance_{{}}_hpatch_{{:03d}}', owner, row_number() OVER (PARTITION BY scene_id, owner ORDER BY round(mz, 9) DESC, round(projected_area, 9) DESC, digest) - 1) AS patch_uid,
    list_filter([CASE WHEN area_share < {_L.area_share} THEN 'projected_area_ratio_below_min' END, CASE WHEN coverage < {_L.coverage} THEN 'coverage_below_min' END,
      CASE WHEN rough / owner_diagonal > {_L.roughness} THEN 'roughness_ratio_above_max' END, CASE WHEN tilt > {_L.angle} THEN 'fitted_plane_tilt_above_max' END], lambda x: x IS NOT NULL) AS reasons FROM measured
)"""


def _patches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    every, faces, vertices = scene_mesh(spark, sf)
    return every, settled(ops.entity_patches(faces, settled(vertices, "mesh-vertices")), "patches")


@_query(f"""{_PATCHES}
SELECT scene_id, owner, patch_uid, round(px, 6) + 0e0 AS a, round(py, 6) + 0e0 AS b, round(pz, 6) + 0e0 AS c, round(d, 6) + 0e0 AS d, round(mz, 6) AS height, round(mesh_area, 6) AS mesh_area, round(projected_area, 6) AS projected_area,
  round(footprint_area, 6) AS footprint_area, round(coverage, 5) AS coverage, round(area_share, 5) AS area_share, round(roughness_ratio, 6) AS roughness_ratio, round(tilt, 4) AS tilt, n_faces, n_vertices,
  digest AS faces_sha256, len(reasons) = 0 AS qualifies, array_to_string(reasons, ',') AS reasons FROM patch""")
def entity_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Horizontal patches of every instance with their planes, measures and reasons."""
    found = _patches(spark, sf)[1]
    six = {"a": "px", "b": "py", "c": "pz", "d": "d", "height": "height", "mesh_area": "mesh_area", "projected_area": "projected_area", "footprint_area": "footprint_area", "roughness_ratio": "roughness_ratio"}
    return found.select(
        "scene_id", "owner", "patch_uid", *[(F.round(c, 6) + 0.0).alias(k) for k, c in six.items()], F.round("coverage", 5).alias("coverage"), F.round("area_share", 5).alias("area_share"), F.round("tilt", 4).alias("tilt"),
        "n_faces", "n_vertices", "faces_sha256", "qualifies", F.array_join("reasons", ",").alias("reasons"),
    )


_R = ops.RestLimits()
_FLOORS = f"""{_PATCHES}
, extent AS (SELECT scene_id, (max(x1) - min(x0)) * (max(y1) - min(y0)) AS scene_area, min(z0) AS z_min, min(z0) + {_R.floor_height}e0 * (max(z1) - min(z0)) AS low_max FROM box GROUP BY ALL
), low AS (SELECT e.scene_id, projected_area / scene_area AS ratio, p.* EXCLUDE (scene_id) FROM patch p JOIN extent e USING (scene_id) WHERE len(reasons) = 0 AND projected_area / scene_area >= {_R.floor_area} AND mz <= low_max
), floored AS (
  SELECT e.*, l.patch_uid, l.owner, l.root, l.ratio, coalesce(n, 0) AS n_candidates FROM extent e LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY scene_id) AS n FROM low QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY ratio DESC, mz, patch_uid) = 1) l USING (scene_id)
)"""


@_query(f"""{_FLOORS}
SELECT scene_id, CASE WHEN patch_uid IS NULL THEN 'unknown' ELSE 'available' END AS status, patch_uid, round(ratio, 6) AS area_ratio, n_candidates, round(low_max, 6) AS low_max, round(scene_area, 6) AS scene_area, round(z_min, 6) AS z_min FROM floored""")
def floor_patches(spark: SparkSession, sf: str) -> DataFrame:
    """The patch that each scene takes for its floor."""
    every, found = _patches(spark, sf)
    six = [F.round(k, 6).alias(k) for k in ("area_ratio", "low_max", "scene_area", "z_min")]
    return ops.floor_patches(every, found).select("scene_id", "status", "patch_uid", "n_candidates", *six)


#: Corners of what a box's footprint and a patch share: corners of either inside the other, and crossings of their sides.
_RESTING = f"""{_FLOORS}
, rim AS MATERIALIZED (SELECT p.scene_id, p.owner, p.root, patch_uid, px, py, pz, d, owner_diagonal, gx, gy, hx, hy FROM patch p JOIN side USING (scene_id, owner, root) WHERE len(reasons) = 0
), span AS (SELECT scene_id, owner, root, patch_uid, any_value(px) AS px, any_value(py) AS py, any_value(pz) AS pz, any_value(d) AS d, any_value(owner_diagonal) AS owner_diagonal, min(gx) AS lx, max(gx) AS ux, min(gy) AS ly, max(gy) AS uy, sum(gx * hy - gy * hx) / 2 AS patch_area FROM rim GROUP BY ALL
), pair AS MATERIALIZED (
  SELECT t.scene_id, t.uid, s.owner, s.root, t.owner AS own, s.patch_uid, t.x0, t.y0, t.z0, t.x1, t.y1, t.z1, s.px, s.py, s.pz, s.d, s.owner_diagonal, s.patch_area
  FROM box t JOIN span s ON s.scene_id = t.scene_id AND t.x0 <= s.ux AND s.lx <= t.x1 AND t.y0 <= s.uy AND s.ly <= t.y1
), met AS (SELECT p.scene_id, p.uid, p.patch_uid, x0, y0, x1, y1, gx, gy, hx, hy FROM pair p JOIN rim r ON r.scene_id = p.scene_id AND r.owner = p.owner AND r.root = p.root
), kept AS (
  SELECT scene_id, uid, patch_uid, gx AS x, gy AS y FROM met WHERE gx BETWEEN x0 AND x1 AND gy BETWEEN y0 AND y1
  UNION ALL SELECT scene_id, uid, patch_uid, c, y FROM (SELECT *, gy + (c - gx) / (hx - gx) * (hy - gy) AS y FROM (SELECT *, unnest([x0, x1]) AS c FROM met) WHERE (gx - c) * (hx - c) < 0) WHERE y BETWEEN y0 AND y1
  UNION ALL SELECT scene_id, uid, patch_uid, x, c FROM (SELECT *, gx + (c - gy) / (hy - gy) * (hx - gx) AS x FROM (SELECT *, unnest([y0, y1]) AS c FROM met) WHERE (gy - c) * (hy - c) < 0) WHERE x BETWEEN x0 AND x1
  UNION ALL SELECT scene_id, uid, patch_uid, cx, cy FROM (SELECT *, unnest([x0, x1, x1, x0]) AS cx, unnest([y0, y0, y1, y1]) AS cy FROM met) GROUP BY ALL HAVING bool_and((hx - gx) * (cy - gy) - (hy - gy) * (cx - gx) >= 0)
), around AS (SELECT *, atan2(y - avg(y) OVER w, x - avg(x) OVER w) AS turn FROM (SELECT DISTINCT * FROM kept) WINDOW w AS (PARTITION BY scene_id, uid, patch_uid)
), chain AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM around WINDOW w AS (PARTITION BY scene_id, uid, patch_uid ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), shared AS (SELECT scene_id, uid, patch_uid, sum(x * ny - nx * y) / 2 AS overlap_area, sum((x + nx) * (x * ny - nx * y)) AS sx, sum((y + ny) * (x * ny - nx * y)) AS sy, list({{'x': x, 'y': y}}) AS corners FROM chain GROUP BY ALL HAVING overlap_area > 0
), gaps AS (
  SELECT p.*, coalesce(overlap_area, 0) AS overlap_area, (x1 - x0) * (y1 - y0) AS target_area, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) + (z1 - z0) * (z1 - z0)) AS target_diagonal,
    z0 + (px * (x0 + x1) / 2 + py * (y0 + y1) / 2 + d) / pz AS gap_centre, z0 + (px * sx / (6 * overlap_area) + py * sy / (6 * overlap_area) + d) / pz AS gap,
    list_min(list_transform(corners, lambda c: z0 + (px * c.x + py * c.y + d) / pz)) AS gap_min, list_max(list_transform(corners, lambda c: z0 + (px * c.x + py * c.y + d) / pz)) AS gap_max
  FROM pair p LEFT JOIN shared s ON s.scene_id = p.scene_id AND s.uid = p.uid AND s.patch_uid = p.patch_uid
), stands AS (
  SELECT b.scene_id, b.uid, CASE WHEN f.patch_uid IS NULL THEN 'unknown' WHEN g.overlap_area >= {_R.floor_overlap} * g.target_area AND g.target_area > 0 AND abs(g.gap) <= {_R.floor_gap}e0 * g.target_diagonal THEN 'contact' ELSE 'clear' END AS floor_state
  FROM box b JOIN floored f USING (scene_id) LEFT JOIN gaps g ON g.scene_id = b.scene_id AND g.uid = b.uid AND g.patch_uid = f.patch_uid
), judged AS (
  SELECT g.*, floor_state, least(target_diagonal, owner_diagonal) AS scale, CASE WHEN target_area > 0 THEN g.overlap_area / target_area ELSE 0 END AS overlap_target, CASE WHEN patch_area > 0 THEN g.overlap_area / patch_area ELSE 0 END AS overlap_patch
  FROM gaps g JOIN stands USING (scene_id, uid) WHERE own <> owner
), told AS (
  SELECT *, list_filter([CASE WHEN target_area <= 2.3e-16 THEN 'target_footprint_degenerate' END, CASE WHEN overlap_target < {_R.overlap} THEN 'footprint_overlap_below_min' END, CASE WHEN gap IS NULL THEN 'vertical_gap_unavailable_without_overlap' END,
    CASE WHEN gap < -{_R.penetration}e0 * scale THEN 'vertical_gap_below_penetration_band' END, CASE WHEN gap > {_R.gap}e0 * scale THEN 'vertical_gap_above_contact_band' END,
    CASE WHEN floor_state = 'contact' THEN 'target_floor_contact' END], lambda x: x IS NOT NULL) AS why FROM judged
)"""


@_query(f"""{_RESTING}
SELECT scene_id, uid, owner, patch_uid, round(overlap_area, 9) AS overlap_area, round(overlap_target, 5) AS overlap_target, round(overlap_patch, 5) AS overlap_patch, round(gap_centre, 6) + 0e0 AS gap_centre, round(gap, 6) + 0e0 AS gap, round(gap_min, 6) + 0e0 AS gap_min,
  round(gap_max, 6) + 0e0 AS gap_max, round(gap / scale, 5) + 0e0 AS gap_ratio, overlap_target >= {_R.contained} AS contained, floor_state, array_to_string(why, ',') AS reasons, len(why) = 0 AS candidate,
  len(why) = 0 AND row_number() OVER (PARTITION BY scene_id, uid, owner ORDER BY len(why) = 0 DESC, overlap_target DESC, abs(gap) NULLS LAST, patch_uid) = 1 AS best FROM told WHERE round(overlap_area, 9) > 0""")
def patch_rest(spark: SparkSession, sf: str) -> DataFrame:
    """Every box and patch whose footprints share an area (to 9 digits): overlap, gaps, and whether the box rests there."""
    every, found = _patches(spark, sf)
    rest = ops.patch_resting(every, found, settled(ops.floor_patches(every, found), "floors")).where(F.round("overlap_area", 9) > 0)
    six = [(F.round(k, 6) + 0.0).alias(k) for k in ("gap_centre", "gap", "gap_min", "gap_max")] + [F.round("overlap_area", 9).alias("overlap_area")] + [(F.round(k, 5) + 0.0).alias(k) for k in ("overlap_target", "overlap_patch", "gap_ratio")]
    return rest.select("scene_id", "uid", "owner", "patch_uid", *six, "contained", "floor_state", F.array_join("reasons", ",").alias("reasons"), "candidate", "best")
