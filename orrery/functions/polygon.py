"""Polygons in the plane as column expressions: arrays of points ``{x, y}``, of any winding.

Folds and filters over the sides; nothing leaves the JVM. A polygon's sides run from
each point to the next and from the last to the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.geometry import box_to_plane, col

#: Slack of a half-plane, and the machine's epsilon, under which sides are parallel and areas nothing.
_EPS = 1e-12
EPSILON = 2.220446049250313e-16
#: Fixed value: how far a polygon's points may be from its surface's plane, in metres.
ON_PLANE = 1e-4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def sides(polygon: Column) -> Column:
    """``[{a, b}]``"""
    turned = F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))
    return F.zip_with(polygon, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def cross(o: Column, a: Column, b: Column) -> Column:
    """Twice the signed area of the triangle o, a, b."""
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def _within(p: Column, a: Column, b: Column) -> Column:
    """Whether p, on the line of a and b, lies between them."""
    return p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def contains(polygon: Column, p: Column) -> Column:
    """Whether p is inside or on the boundary; a polygon of under three points holds nothing."""

    def inside(walls: Column) -> Column:
        edge = F.exists(walls, lambda s: (cross(s["a"], s["b"], p) == 0) & _within(p, s["a"], s["b"]))
        meets = lambda s: ((s["a"]["y"] > p["y"]) != (s["b"]["y"] > p["y"])) & (p["x"] < (s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])
        return edge | (F.size(F.filter(walls, lambda s: F.coalesce(meets(s), F.lit(False)))) % 2 == 1)

    return F.when(F.size(polygon) < 3, False).otherwise(let(sides(polygon), inside))


def segments_meet(s: Column, t: Column) -> Column:
    """Whether two sides share a point."""
    one, two = F.signum(cross(s["a"], s["b"], t["a"])), F.signum(cross(s["a"], s["b"], t["b"]))
    three, four = F.signum(cross(t["a"], t["b"], s["a"])), F.signum(cross(t["a"], t["b"], s["b"]))
    touch = ((one == 0) & _within(t["a"], s["a"], s["b"])) | ((two == 0) & _within(t["b"], s["a"], s["b"])) | ((three == 0) & _within(s["a"], t["a"], t["b"])) | ((four == 0) & _within(s["b"], t["a"], t["b"]))
    return ((one * two < 0) & (three * four < 0)) | touch


def point_to_segment(p: Column, s: Column) -> Column:
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    square = dx * dx + dy * dy
    along = F.when(square > 0, ((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / square).otherwise(0.0)
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    return F.hypot(p["x"] - s["a"]["x"] - t * dx, p["y"] - s["a"]["y"] - t * dy)


def overlap(a: Column, b: Column) -> Column:
    """Whether two polygons, as regions, share a point."""
    crossing = let(sides(b), lambda other: F.exists(sides(a), lambda s: F.exists(other, lambda t: segments_meet(s, t))))
    return F.exists(a, lambda p: contains(b, p)) | F.exists(b, lambda p: contains(a, p)) | crossing


def distance(a: Column, b: Column) -> Column:
    """0 where they overlap, else the least distance of a corner of one to a side of the other."""
    nearest = lambda points, walls: F.array_min(F.transform(points, lambda p: F.array_min(F.transform(walls, lambda s: point_to_segment(p, s)))))
    apart = F.least(let(sides(b), lambda walls: nearest(a, walls)), let(sides(a), lambda walls: nearest(b, walls)))
    return F.when(overlap(a, b), 0.0).otherwise(apart)


def convex_hull(points: Column) -> Column:
    """The hull counter-clockwise from its least point, without points inside its sides."""

    def step(chain: Column, p: Column) -> Column:
        last = F.sequence(F.lit(2), F.size(chain))
        kept = F.array_max(F.transform(last, lambda i: F.when(cross(F.get(chain, i - 2), F.get(chain, i - 1), p) > 0, i).otherwise(1)))
        return F.concat(F.when(F.size(chain) < 2, chain).otherwise(F.slice(chain, 1, kept)), F.array(p))

    none = F.array().cast("array<struct<x:double,y:double>>")
    half = lambda ordered: let(F.aggregate(ordered, none, step), lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))))
    hull = lambda p: F.when(F.size(p) < 2, p).otherwise(F.concat(half(p), half(F.reverse(p))))
    return let(F.array_sort(F.array_distinct(points)), hull)


def signed_area(polygon: Column) -> Column:
    """Shoelace: positive where the polygon runs counter-clockwise."""
    total = F.aggregate(sides(polygon), F.lit(0.0), lambda sum_, s: sum_ + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])
    return F.when(F.size(polygon) < 3, 0.0).otherwise(total / 2)


def area(polygon: Column) -> Column:
    return F.abs(signed_area(polygon))


def centroid(polygon: Column) -> Column:
    """The centroid of the area; the mean of the points where there is no area; null without points."""

    def weighed(signed: Column) -> Column:
        zero = point(F.lit(0.0), F.lit(0.0))

        def add(sum_: Column, s: Column) -> Column:
            w = s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
            return point(sum_["x"] + (s["a"]["x"] + s["b"]["x"]) * w, sum_["y"] + (s["a"]["y"] + s["b"]["y"]) * w)

        moments = F.aggregate(sides(polygon), zero, add)
        mean = F.aggregate(polygon, zero, lambda sum_, q: point(sum_["x"] + q["x"], sum_["y"] + q["y"]))
        flat = let(mean, lambda m: point(m["x"] / F.size(polygon), m["y"] / F.size(polygon)))
        full = let(moments, lambda m: point(m["x"] / (6 * signed), m["y"] / (6 * signed)))
        return F.when(F.size(polygon) == 0, None).when(F.abs(signed) > EPSILON, full).otherwise(flat)

    return let(signed_area(polygon), weighed)


def counter_clockwise(polygon: Column) -> Column:
    return F.when(signed_area(polygon) < 0, F.reverse(polygon)).otherwise(polygon)


def clip(subject: Column, window: Column) -> Column:
    """The part of a convex polygon inside another one: cut by each side of the window in turn."""
    none = F.array().cast("array<struct<x:double,y:double>>")

    def meeting(p: Column, q: Column, cut: Column) -> Column:
        rx, ry = q["x"] - p["x"], q["y"] - p["y"]
        sx, sy = cut["b"]["x"] - cut["a"]["x"], cut["b"]["y"] - cut["a"]["y"]
        across = rx * sy - ry * sx
        t = ((cut["a"]["x"] - p["x"]) * sy - (cut["a"]["y"] - p["y"]) * sx) / F.nullif(across, F.lit(0.0))
        return F.coalesce(F.when(F.abs(across) > EPSILON, point(p["x"] + t * rx, p["y"] + t * ry)), q)

    def halved(left: Column, cut: Column) -> Column:
        within = lambda p: cross(cut["a"], cut["b"], p) >= -_EPS
        before = F.concat(F.slice(left, -1, 1), F.slice(left, 1, F.greatest(F.size(left) - 1, F.lit(0))))
        parts = F.zip_with(before, left, lambda p, q: F.concat(F.when(within(p) != within(q), F.array(meeting(p, q, cut))).otherwise(none), F.when(within(q), F.array(q)).otherwise(none)))
        return F.when(F.size(left) == 0, none).otherwise(F.flatten(parts))

    return F.aggregate(sides(counter_clockwise(window)), counter_clockwise(subject), halved)


def plane_basis(plane: str) -> tuple[list[Column], list[Column]]:
    """Unit vectors u and v that span a plane: u is at right angles to the axis its normal leans to least (x before y before z)."""
    normal = [col(plane, n) for n in "abc"]
    size = F.sqrt(sum((n * n for n in normal), F.lit(0.0)))
    n = [c / size for c in normal]
    first, second = (F.abs(n[0]) <= F.abs(n[1])) & (F.abs(n[0]) <= F.abs(n[2])), F.abs(n[1]) <= F.abs(n[2])
    axis = [F.when(first, x).when(second, y).otherwise(z) for x, y, z in ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))]
    product = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    unit = lambda a: [c / F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2]) for c in a]
    u = unit(product(n, axis))
    return u, product(n, u)


def on_plane(p: list[Column], basis: tuple[list[Column], list[Column]]) -> Column:
    """A point of space in a plane's own coordinates."""
    u, v = basis
    return point(sum((a * b for a, b in zip(p, u, strict=True)), F.lit(0.0)), sum((a * b for a, b in zip(p, v, strict=True)), F.lit(0.0)))


def box_shadow(box: str, basis: tuple[list[Column], list[Column]]) -> Column:
    """The hull of a box's eight corners as they fall on a plane."""
    corners = [[col(box, f"{k}{end}") for k, end in zip("xyz", ends, strict=True)] for ends in ((i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1))]
    return convex_hull(F.array(*(on_plane(c, basis) for c in corners)))


#: Columns of the unit vectors that span a surface's plane.
AXES_OF_PLANE = tuple(f"{side}{k}" for side in "uv" for k in "xyz")


def placed(surfaces: DataFrame) -> DataFrame:
    """Surfaces (a, b, c, d, polygon of points {x, y, z}) with their plane's axes and ``pane``, the polygon in its own plane.

    Worked out once a surface and not once a pair. A polygon point further than ON_PLANE from the plane fails the job.
    """
    u, v = plane_basis("")
    based = surfaces.withColumns(dict(zip(AXES_OF_PLANE, (*u, *v), strict=True)))
    off = F.exists("polygon", lambda q: F.abs(F.col("a") * q["x"] + F.col("b") * q["y"] + F.col("c") * q["z"] + F.col("d")) > ON_PLANE)
    at = lambda q, side: F.col(f"{side}x") * q["x"] + F.col(f"{side}y") * q["y"] + F.col(f"{side}z") * q["z"]
    pane = F.transform("polygon", lambda q: point(at(q, "u"), at(q, "v")))
    kind = "array<struct<x:double,y:double>>"
    failed = F.raise_error(F.lit("a polygon does not lie on its surface's plane")).cast(kind)
    return based.withColumn("pane", F.when(off, failed).otherwise(pane).cast(kind))


def surface_gap(box: str, surface: str) -> Column:
    """Gap of a box's shadow to the pane of a placed surface, in its plane.

    0 where they overlap, infinite for fewer than three points, null without a polygon.
    """
    basis = tuple([col(surface, f"{side}{k}") for k in "xyz"] for side in "uv")
    pane = col(surface, "pane")
    gap = let(F.struct(box_shadow(box, basis).alias("shadow"), pane.alias("pane")), lambda x: distance(x["shadow"], x["pane"]))
    return F.when(pane.isNull(), None).when(F.size(pane) < 3, F.lit(float("inf"))).otherwise(gap)


def box_to_surface(box: str, surface: str, shaped: bool = True) -> Column:
    """``{distance, distance_metric, clipped, normal_gap, in_plane_gap, fallback_reason}`` of a box and a surface.

    With a polygon the distance joins the gap along the normal and the gap in the plane; without
    one (null, or ``shaped`` false: no such column) it is the plane's alone, and fallback_reason says so.
    """
    inside = surface_gap(box, surface) if shaped else F.lit(None).cast("double")

    def told(m: Column) -> Column:
        has = m["inside"].isNotNull()
        return F.struct(
            F.when(has, F.hypot(m["normal"], m["inside"])).otherwise(m["normal"]).alias("distance"),
            F.when(has, "polygon_clipped").otherwise("bbox_to_plane").alias("distance_metric"),
            has.alias("clipped"), m["normal"].alias("normal_gap"), m["inside"].alias("in_plane_gap"),
            F.when(~has, "polygon_none").alias("fallback_reason"),
        )

    return let(F.struct(box_to_plane(box, surface).alias("normal"), inside.alias("inside")), told)
