"""Scalar geometry as column expressions: boxes, planes and points.

A box is the six columns x0..z1 and its centroid cx, cy, cz, with an optional
prefix; a plane is a, b, c, d with a unit normal. All arithmetic is on doubles and
stays inside code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def col(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}.{name}" if prefix else name)


def root_sum(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def centroid_distance(a: str, b: str) -> Column:
    return root_sum(*[col(a, f"c{k}") - col(b, f"c{k}") for k in AXES])


def axis_gap(a: str, b: str, axis: str) -> Column:
    """Distance of two boxes along an axis; 0 where they overlap."""
    return F.greatest(F.lit(0.0), col(a, f"{axis}0") - col(b, f"{axis}1"), col(b, f"{axis}0") - col(a, f"{axis}1"))


def box_distance(a: str, b: str) -> Column:
    return root_sum(*[axis_gap(a, b, k) for k in AXES])


def point_to_box(point: list[Column], box: str) -> Column:
    return root_sum(*[F.greatest(F.lit(0.0), col(box, f"{k}0") - p, p - col(box, f"{k}1")) for k, p in zip(AXES, point, strict=True)])


def point_to_plane(point: list[Column], plane: str) -> Column:
    """Signed distance along the plane's normal."""
    return sum((col(plane, n) * p for n, p in zip("abc", point, strict=True)), F.lit(0.0)) + col(plane, "d")


def centroid_to_plane(box: str, plane: str) -> Column:
    return point_to_plane([col(box, f"c{k}") for k in AXES], plane)


def corner_range(box: str, plane: str) -> tuple[Column, Column]:
    """Least and greatest signed distance of a box's corners, in closed form."""
    middle = point_to_plane([(col(box, f"{k}0") + col(box, f"{k}1")) / 2 for k in AXES], plane)
    reach = sum((F.abs(col(plane, n)) * (col(box, f"{k}1") - col(box, f"{k}0")) / 2 for n, k in zip("abc", AXES, strict=True)), F.lit(0.0))
    return middle - reach, middle + reach


def box_to_plane(box: str, plane: str) -> Column:
    low, high = corner_range(box, plane)
    return F.when((low <= 0) & (high >= 0), 0.0).otherwise(F.least(F.abs(low), F.abs(high)))


def in_plane_gap(box: str, surface: str) -> Column:
    """Gap of a box to an axis-aligned rectangle, along the axes that lie in its plane."""
    return root_sum(*[F.when(F.abs(col(surface, n)) > 0.5, 0.0).otherwise(axis_gap(box, surface, k)) for n, k in zip("abc", AXES, strict=True)])


def volume(box: str) -> Column:
    return (col(box, "x1") - col(box, "x0")) * (col(box, "y1") - col(box, "y0")) * (col(box, "z1") - col(box, "z0"))


def intersection(a: str, b: str) -> Column:
    sides = [F.greatest(F.lit(0.0), F.least(col(a, f"{k}1"), col(b, f"{k}1")) - F.greatest(col(a, f"{k}0"), col(b, f"{k}0"))) for k in AXES]
    return sides[0] * sides[1] * sides[2]


def box_iou(a: str, b: str) -> Column:
    both = intersection(a, b)
    union = volume(a) + volume(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def diagonal(box: str) -> Column:
    return root_sum(*[col(box, f"{k}1") - col(box, f"{k}0") for k in AXES])


def footprint(box: str) -> Column:
    return (col(box, "x1") - col(box, "x0")) * (col(box, "y1") - col(box, "y0"))


def inside_xy(point: str, box: str) -> Column:
    return (col(point, "cx") >= col(box, "x0")) & (col(point, "cx") <= col(box, "x1")) & (col(point, "cy") >= col(box, "y0")) & (col(point, "cy") <= col(box, "y1"))


def oriented_half_extent(rotation: list[list[Column]], half: list[Column]) -> list[Column]:
    """Half extents of the tight box around an oriented box: sum of |R| h."""
    return [sum((F.abs(r) * h for r, h in zip(row, half, strict=True)), F.lit(0.0)) for row in rotation]


def quaternion_matrix(x: Column, y: Column, z: Column, w: Column) -> list[list[Column]]:
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def dominant_yaw(angle: Column, weight: Column) -> Column:
    """Length-weighted circular mean of wall directions modulo 90 degrees, in [-45, 45) (an aggregate)."""
    mean = F.atan2(F.sum(weight * F.sin(4 * angle)), F.sum(weight * F.cos(4 * angle))) / 4
    return F.degrees(mean)


def margin_confidence(margin: Column, steepness: float = 4.0) -> Column:
    """A signed margin as a confidence: 0.5 on the boundary, and for an unknown margin."""
    z = F.least(F.greatest(margin * steepness, F.lit(-50.0)), F.lit(50.0))
    return F.when(F.isnan(margin) | margin.isNull(), 0.5).otherwise(1 / (1 + F.exp(-z)))


def ratio_margin(measured: Column, limit: Column) -> Column:
    return F.when(limit <= 0, F.when(measured <= limit, math.inf).otherwise(-math.inf)).otherwise((limit - measured) / limit)


def band_margin(measured: Column, low: float, high: float) -> Column:
    half = (high - low) / 2
    return F.least(measured - low, high - measured) / half if half > 0 else F.lit(math.inf)


def dominance_margin(dx: Column, dy: Column, dz: Column, least: float) -> Column:
    sizes = F.array_sort(F.array(F.abs(dx), F.abs(dy), F.abs(dz)))
    return (F.element_at(sizes, 3) - F.greatest(F.lit(least), F.element_at(sizes, 2))) / least
