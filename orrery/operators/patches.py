"""Horizontal patches of a mesh's instances, the floor among them, and what rests on them.

A patch is a connected set of nearly horizontal faces that lie wholly in one
instance. Its plane is the least-squares plane of its faces, weighted by area. All of
it is joins and aggregates; components contract by stars, and a hull is made of
the hulls of bounded buckets of vertices.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions import polygon as poly
from orrery.functions.digests import ids_sha256
from orrery.functions.linear import Spread, least_eigenvalue, null_axis, weighted_spread
from orrery.operators.boxjoin import footprints_meeting
from orrery.operators.components import components
from orrery.sources.tables import settled

#: Vertices of a bucket whose hull is made at once.
BUCKET = 256


@dataclass(frozen=True)
class PatchLimits:
    """What a horizontal face and a patch that qualifies must keep to."""

    angle: float = 15.0
    faces: int = 2
    area_share: float = 0.005
    coverage: float = 0.25
    roughness: float = 0.01


@dataclass(frozen=True)
class RestLimits:
    """Bands in shares of the smaller diagonal (gap, penetration) or of the target's (floor), and least overlaps."""

    gap: float = 0.05
    penetration: float = 0.02
    overlap: float = 0.50
    contained: float = 0.95
    floor_area: float = 0.15
    floor_height: float = 0.20
    floor_gap: float = 0.03
    floor_overlap: float = 0.50
    unknown_floor_rejects: bool = False


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def owners(vertices: DataFrame) -> DataFrame:
    """``scene_id, owner, n_assigned`` and the box, diagonals and plan area of every instance (instance >= 0)."""
    ends = [f(k).alias(f"{k}{n}") for n, f in ((0, F.min), (1, F.max)) for k in "xyz"]
    boxes = vertices.where("instance >= 0").groupBy("scene_id", F.col("instance").alias("owner")).agg(F.count(F.lit(1)).alias("n_assigned"), *ends)
    return boxes.withColumns({"owner_diagonal": g.diagonal(""), "horizontal_diagonal": F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), "plan_area": g.footprint("")})


def strict_faces(faces: DataFrame, vertices: DataFrame, up: tuple[float, float, float] = (0.0, 0.0, 1.0), limits: PatchLimits = PatchLimits()) -> DataFrame:
    """``scene_id, owner, fid, corners, area, n, horizontal`` of faces whose three corners have one instance.

    n is the unit normal; a face without area has none and is not horizontal. faces: scene_id, fid, a, b, c.
    """
    full = faces
    for k in "abc":
        full = full.join(vertices.select("scene_id", F.col("vid").alias(k), F.struct("x", "y", "z").alias(f"p{k}"), F.col("instance").alias(f"i{k}")), ["scene_id", k])
    same = full.where("ia = ib and ib = ic and ia >= 0")
    u, v = ([F.col(f"p{k}.{t}") - F.col(f"pa.{t}") for t in "xyz"] for k in "bc")
    twice = same.withColumn("cross", F.array(*_cross(u, v))).withColumn("twice", F.sqrt(F.aggregate("cross", F.lit(0.0), lambda s, x: s + x * x)))
    n = F.when(F.col("twice") > poly.EPSILON, F.transform("cross", lambda x: x / F.col("twice")))
    lean = F.abs(_dot([F.get("n", F.lit(k)) for k in range(3)], [F.lit(x) for x in up]))
    corners = F.array(*[F.struct(F.col(k).alias("vid"), F.col(f"p{k}").alias("at")) for k in "abc"])
    shaped = twice.select("scene_id", F.col("ia").alias("owner"), "fid", corners.alias("corners"), (F.col("twice") / 2).alias("area"), n.alias("n"))
    return shaped.withColumn("horizontal", F.coalesce(lean >= math.cos(math.radians(limits.angle)), F.lit(False)))


def face_components(faces: DataFrame) -> DataFrame:
    """``faces`` with ``root``: the least face that shared edges lead to, within one owner."""
    corner = lambda k: F.get("corners.vid", F.lit(k))
    edge = F.array(*[F.struct(F.least(corner(i), corner(j)).alias("lo"), F.greatest(corner(i), corner(j)).alias("hi")) for i, j in ((0, 1), (1, 2), (2, 0))])
    every = faces.select("scene_id", "owner", "fid", F.explode(edge).alias("edge"))
    # the least face of an edge stands for all that share it
    links = every.groupBy("scene_id", "owner", "edge").agg(F.min("fid").alias("first"), F.collect_set("fid").alias("fids")).select("scene_id", "owner", "first", F.explode("fids").alias("fid"))
    found = components(links, ["scene_id", "owner"], "first", "fid").withColumnRenamed("node", "fid")
    return faces.join(found, ["scene_id", "owner", "fid"])


def _plane_axes(n: list[Column]) -> tuple[list[Column], list[Column]]:
    """Unit vectors that span a plane: u is the x axis made level with it, or the y axis where x is near its normal."""
    steep = F.abs(n[0]) > 0.9
    ref = [F.when(steep, 0.0).otherwise(1.0), F.when(steep, 1.0).otherwise(0.0), F.lit(0.0)]
    along = _dot(ref, n)
    flat = [r - c * along for r, c in zip(ref, n, strict=True)]
    size = F.sqrt(_dot(flat, flat))
    u = [c / size for c in flat]
    return u, _cross(n, u)


def fitted(comps: DataFrame, up: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """One row a component (scene_id, owner, root): plane, height, areas, hull on the plane and counts."""
    key = ["scene_id", "owner", "root"]
    weighed = comps.select(*key, "fid", "area", "n", (F.col("area") / 3).alias("w"), F.explode("corners").alias("c")).select(*key, "fid", "area", "n", "w", "c.vid", "c.at.x", "c.at.y", "c.at.z")
    mean = weighed.groupBy(*key).agg(*[(F.sum(F.col("w") * F.col(k)) / F.sum("w")).alias(f"m{k}") for k in "xyz"])
    near = weighed.join(mean, key).withColumns({f"d{k}": F.col(k) - F.col(f"m{k}") for k in "xyz"})
    spread = near.groupBy(*key, "mx", "my", "mz").agg(*[c.alias(k) for k, c in weighted_spread(F.col("w"), F.col("dx"), F.col("dy"), F.col("dz")).items()])
    matrix = Spread(*[F.col(k) for k in ("xx", "xy", "xz", "yy", "yz", "zz")])
    axis = spread.withColumn("least", least_eigenvalue(matrix)).withColumn("axis", null_axis(matrix, F.col("least")))
    toward = F.when(_dot([F.col(f"axis.{k}") for k in "xyz"], [F.lit(x) for x in up]) < 0, -1.0).otherwise(1.0)
    planes = axis.select(*key, "mx", "my", "mz", F.sqrt(F.greatest("least", F.lit(0.0))).alias("roughness"), *[(toward * F.col(f"axis.{k}")).alias(f"p{k}") for k in "xyz"])
    normal = [F.col(f"p{k}") for k in "xyz"]
    middle = [F.col(f"m{k}") for k in "xyz"]
    leaned = F.degrees(F.acos(F.greatest(F.least(_dot(normal, [F.lit(x) for x in up]), F.lit(1.0)), F.lit(-1.0))))
    planes = settled(planes.withColumns({"d": -_dot(normal, middle), "height": _dot(middle, [F.lit(x) for x in up]), "tilt": leaned}), "patch-planes")

    face = F.abs(_dot([F.get("n", F.lit(k)) for k in range(3)], normal)) * F.col("area")
    sums = comps.join(planes, key).groupBy(*key).agg(F.sum("area").alias("mesh_area"), F.sum(face).alias("projected_area"), F.count(F.lit(1)).alias("n_faces"), ids_sha256(F.array_sort(F.collect_list("fid"))).alias("faces_sha256"))
    points = weighed.select(*key, "vid", "x", "y", "z").distinct().join(planes, key)
    u, v = _plane_axes(normal)
    local = [F.col(k) - F.col(f"m{k}") for k in "xyz"]
    placed = points.select(*key, "vid", poly.point(_dot(local, u), _dot(local, v)).alias("q"))
    # hulls of buckets first, so that no task gathers all vertices of a large patch
    part = placed.groupBy(*key, F.floor(F.col("vid") / BUCKET).alias("bucket")).agg(poly.convex_hull(F.collect_list("q")).alias("hull"), F.count(F.lit(1)).alias("n"))
    hull = part.groupBy(*key).agg(poly.convex_hull(F.flatten(F.collect_list("hull"))).alias("hull"), F.sum("n").alias("n_vertices"))
    whole = planes.join(sums, key).join(hull, key)
    back = F.transform("hull", lambda q: F.struct(*[(F.col(f"m{k}") + q["x"] * a + q["y"] * b).alias(k) for k, a, b in zip("xyz", u, v, strict=True)]))
    return whole.withColumns({"polygon": back, "footprint_area": poly.area(F.col("hull"))})


def _reasons(*named: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, name) for cond, name in named]))


def entity_patches(faces: DataFrame, vertices: DataFrame, up: tuple[float, float, float] = (0.0, 0.0, 1.0), limits: PatchLimits = PatchLimits()) -> DataFrame:
    """The horizontal patches of every instance, with ``patch_uid``, measures, ``qualifies`` and ``reasons``.

    Components of under ``limits.faces`` faces are no patches. An instance's patches are numbered from
    the highest, then largest (both to 9 digits, below which rounding decides), then by the digest of their faces. vertices: scene_id, vid,
    x, y, z, instance (-1 for none; one of -1 or another never makes a patch).
    """
    own = owners(vertices)
    flat = settled(face_components(strict_faces(faces, vertices, up, limits).where("horizontal")), "horizontal-faces")
    large = flat.groupBy("scene_id", "owner", "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limits.faces)
    every = fitted(flat.join(large.drop("n"), ["scene_id", "owner", "root"], "left_semi"), up).join(own, ["scene_id", "owner"])
    share = F.when(F.col("plan_area") > 0, F.col("projected_area") / F.col("plan_area")).otherwise(0.0)
    cover = F.when(F.col("footprint_area") > 0, F.col("projected_area") / F.col("footprint_area")).otherwise(0.0)
    rough = F.when(F.col("owner_diagonal") > 0, F.col("roughness") / F.col("owner_diagonal")).otherwise(math.inf)
    measured = every.withColumns({"area_share": share, "coverage": cover, "roughness_ratio": rough})
    small = F.col("plan_area") <= poly.EPSILON
    reasons = _reasons(
        (F.col("n_faces") < limits.faces, "too_few_faces"),
        (F.col("footprint_area") <= poly.EPSILON, "degenerate_footprint"),
        (small, "degenerate_owner_plan_area"),
        (~small & (F.col("area_share") < limits.area_share), "projected_area_ratio_below_min"),
        (F.col("coverage") < limits.coverage, "coverage_below_min"),
        (F.col("owner_diagonal") <= 0, "degenerate_owner_diagonal"),
        ((F.col("owner_diagonal") > 0) & (F.col("roughness_ratio") > limits.roughness), "roughness_ratio_above_max"),
        (F.col("tilt") > limits.angle, "fitted_plane_tilt_above_max"),
    )
    order = Window.partitionBy("scene_id", "owner").orderBy(F.desc(F.round("height", 9)), F.desc(F.round("projected_area", 9)), "faces_sha256")
    uid = F.format_string("instance_%d_hpatch_%03d", "owner", F.row_number().over(order) - 1)
    return measured.withColumns({"patch_uid": uid, "reasons": reasons}).withColumn("qualifies", F.size("reasons") == 0)


def floor_patches(boxes: DataFrame, patches: DataFrame, limits: RestLimits = RestLimits()) -> DataFrame:
    """``scene_id, status, patch_uid, area_ratio, n_candidates, low_max, scene_area, z_min``: a large low patch as each scene's floor.

    Largest share of the scene's plan first, then lowest, then by name; ``unknown`` where no patch qualifies.
    """
    ends = [f(k).alias(f"s{k}") for k, f in (("x0", F.min), ("y0", F.min), ("z0", F.min), ("x1", F.max), ("y1", F.max), ("z1", F.max))]
    extent = boxes.groupBy("scene_id").agg(*ends)
    area = (F.col("sx1") - F.col("sx0")) * (F.col("sy1") - F.col("sy0"))
    scenes = extent.select("scene_id", area.alias("scene_area"), F.col("sz0").alias("z_min"), (F.col("sz0") + limits.floor_height * (F.col("sz1") - F.col("sz0"))).alias("low_max"))
    ratio = F.when(F.col("scene_area") > 0, F.col("projected_area") / F.col("scene_area")).otherwise(0.0)
    able = patches.where("qualifies").join(scenes, "scene_id").withColumn("ratio", ratio).where((F.col("ratio") >= limits.floor_area) & (F.col("height") <= F.col("low_max")))
    best = able.groupBy("scene_id").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "height", "patch_uid")).alias("best"), F.count(F.lit(1)).alias("n_candidates"))
    told = scenes.join(best, "scene_id", "left")
    status = F.when(F.col("best").isNotNull(), "available").otherwise("unknown")
    return told.select("scene_id", status.alias("status"), F.col("best.patch_uid").alias("patch_uid"), (-F.col("best.r")).alias("area_ratio"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), "low_max", "scene_area", "z_min")


def _measured(pairs: DataFrame) -> DataFrame:
    """Pairs of a target's box ``t`` and a patch ``s`` with overlap and gaps; null gaps where footprints share no area."""
    lo, hi = (lambda k: F.col(f"t.{k}0")), (lambda k: F.col(f"t.{k}1"))
    rect = F.array(poly.point(lo("x"), lo("y")), poly.point(hi("x"), lo("y")), poly.point(hi("x"), hi("y")), poly.point(lo("x"), hi("y")))
    shadow = F.transform("s.polygon", lambda q: poly.point(q["x"], q["y"]))
    gap = lambda x, y: lo("z") + (F.col("s.px") * x + F.col("s.py") * y + F.col("s.d")) / F.col("s.pz")
    area = g.footprint("t")
    able = (F.size("shadow") >= 3) & (area > 0)
    none = F.array().cast("array<struct<x:double,y:double>>")
    shaped = pairs.withColumn("shadow", shadow).withColumn("shared", F.when(able, poly.clip(rect, F.col("shadow"))).otherwise(none))
    sized = shaped.withColumns({"overlap_area": poly.area(F.col("shared")), "patch_area": poly.area(F.col("shadow")), "target_area": area})
    full = F.col("overlap_area") > 0
    at = sized.withColumn("centre", F.when(full, poly.centroid(F.col("shared")))).withColumn("gaps", F.when(full, F.transform("shared", lambda q: gap(q["x"], q["y"]))))
    return at.withColumns({
        "overlap_target": F.when(area > 0, F.col("overlap_area") / area).otherwise(0.0),
        "overlap_patch": F.when(F.col("patch_area") > 0, F.col("overlap_area") / F.col("patch_area")).otherwise(0.0),
        "gap_centre": gap((lo("x") + hi("x")) / 2, (lo("y") + hi("y")) / 2),
        "gap": F.when(full, gap(F.col("centre.x"), F.col("centre.y"))),
        "gap_min": F.array_min("gaps"), "gap_max": F.array_max("gaps"), "target_diagonal": g.diagonal("t"),
    })


def floor_contact(boxes: DataFrame, patches: DataFrame, floors: DataFrame, limits: RestLimits = RestLimits()) -> DataFrame:
    """``scene_id, uid, floor_state``: whether a box stands on its scene's floor patch: contact, clear or unknown."""
    floor = patches.join(floors.select("scene_id", "patch_uid").where("patch_uid is not null"), ["scene_id", "patch_uid"])
    pairs = boxes.select("scene_id", F.struct("*").alias("t")).join(floor.select("scene_id", F.struct("polygon", "px", "py", "pz", "d").alias("s")), "scene_id", "left")
    band = limits.floor_gap * F.col("target_diagonal")
    stands = (F.col("target_diagonal") > 0) & (F.col("overlap_target") >= limits.floor_overlap) & F.col("gap").between(-band, band)
    state = F.when(F.col("s").isNull(), "unknown").when(F.coalesce(stands, F.lit(False)), "contact").otherwise("clear")
    return _measured(pairs).select("scene_id", F.col("t.uid").alias("uid"), state.alias("floor_state"))


def patch_resting(boxes: DataFrame, patches: DataFrame, floors: DataFrame, limits: RestLimits = RestLimits()) -> DataFrame:
    """What a target's box (scene_id, uid, owner, x0..z1) has to do with each patch under or over it, one row a target and patch.

    Only pairs whose footprints meet are here, found by a grid and not by pairing
    all; every other pair of a target and a qualifying patch is rejected for want of overlap. ``best``
    marks the one patch of a target and owner that it rests on: candidates by overlap, then least gap, then name.
    """
    able = patches.where("qualifies")
    span = lambda k, f: f(F.transform("polygon", lambda q: q[k]))
    shadows = able.withColumns({f"{k}{n}": span(k, f) for k in "xy" for n, f in ((0, F.array_min), (1, F.array_max))})
    pairs = footprints_meeting(boxes, shadows).where("t.owner is null or t.owner <> s.owner")
    scale = F.least("target_diagonal", "s.owner_diagonal")
    known = _measured(pairs).withColumn("scale", scale).withColumn("uid", F.col("t.uid")).join(floor_contact(boxes, patches, floors, limits), ["scene_id", "uid"])
    tiny = F.col("scale") <= poly.EPSILON
    reasons = _reasons(
        (F.col("target_area") <= poly.EPSILON, "target_footprint_degenerate"),
        (F.col("overlap_target") < limits.overlap, "footprint_overlap_below_min"),
        (tiny, "relation_scale_degenerate"),
        (~tiny & F.col("gap").isNull(), "vertical_gap_unavailable_without_overlap"),
        (~tiny & (F.col("gap") < -limits.penetration * F.col("scale")), "vertical_gap_below_penetration_band"),
        (~tiny & (F.col("gap") > limits.gap * F.col("scale")), "vertical_gap_above_contact_band"),
        (F.col("floor_state") == "contact", "target_floor_contact"),
        ((F.col("floor_state") == "unknown") & F.lit(limits.unknown_floor_rejects), "target_floor_contact_unknown"),
    )
    judged = known.withColumn("reasons", reasons).withColumn("candidate", F.size("reasons") == 0)
    order = Window.partitionBy("scene_id", "uid", "s.owner").orderBy(F.desc("candidate"), F.desc("overlap_target"), F.abs("gap").asc_nulls_last(), F.col("s.patch_uid"))
    ranked = judged.withColumn("best", F.col("candidate") & (F.row_number().over(order) == 1))
    return ranked.select(
        "scene_id", "uid", F.col("s.owner").alias("owner"), F.col("s.patch_uid").alias("patch_uid"), "overlap_area", "overlap_target", "overlap_patch", "gap_centre", "gap", "gap_min", "gap_max", "scale",
        F.when(F.col("scale") > 0, F.col("gap") / F.col("scale")).alias("gap_ratio"), (F.col("overlap_target") >= limits.contained).alias("contained"), "floor_state", "reasons", "candidate", "best",
    )
