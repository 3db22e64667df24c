"""Symmetric 3 x 3 matrices as columns: the axis of least spread of weighted points."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.polygon import let


class Spread(NamedTuple):
    """The upper triangle of a symmetric matrix."""

    xx: Column
    xy: Column
    xz: Column
    yy: Column
    yz: Column
    zz: Column


def weighted_spread(weight: Column, dx: Column, dy: Column, dz: Column) -> dict[str, Column]:
    """Aggregates: the covariance of points already taken relative to their weighted mean."""
    total = F.sum(weight)
    parts = {"xx": dx * dx, "xy": dx * dy, "xz": dx * dz, "yy": dy * dy, "yz": dy * dz, "zz": dz * dz}
    return {name: F.sum(weight * product) / total for name, product in parts.items()}


def least_eigenvalue(m: Spread) -> Column:
    """By the trigonometric form of the characteristic cubic's roots."""
    q = (m.xx + m.yy + m.zz) / 3

    def root(mean: Column) -> Column:
        x, y, z = m.xx - mean, m.yy - mean, m.zz - mean
        size = F.sqrt((x * x + y * y + z * z + 2 * (m.xy * m.xy + m.xz * m.xz + m.yz * m.yz)) / 6)
        det = x * (y * z - m.yz * m.yz) - m.xy * (m.xy * z - m.yz * m.xz) + m.xz * (m.xy * m.yz - y * m.xz)
        ratio = F.greatest(F.least(det / (2 * F.nullif(size * size * size, F.lit(0.0))), F.lit(1.0)), F.lit(-1.0))
        return F.coalesce(mean + 2 * size * F.cos(F.acos(ratio) / 3 + 2 * math.pi / 3), mean)

    return let(q, root)


def null_axis(m: Spread, value: Column) -> Column:
    """``x, y, z``: the unit vector that m - value sends to zero: the longest cross product of two of its rows.

    Null where all of them vanish, that is, where the axis is not unique.
    """
    rows = [[m.xx - value, m.xy, m.xz], [m.xy, m.yy - value, m.yz], [m.xz, m.yz, m.zz - value]]

    def product(a: list[Column], b: list[Column]) -> Column:
        v = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
        return F.struct(F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]).alias("size"), *[c.alias(k) for c, k in zip(v, "xyz", strict=True)])

    longest = F.array_max(F.array(product(rows[0], rows[1]), product(rows[1], rows[2]), product(rows[2], rows[0])))
    return let(longest, lambda p: F.when(p["size"] > 0, F.struct(*[(p[k] / p["size"]).alias(k) for k in "xyz"])))
