"""Contact predicates of a box with a plane rectangle or polygon, as columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions.polygon import surface_gap


@dataclass(frozen=True)
class Contact:
    """Limits of a contact test, in metres and degrees."""

    contact: float = 0.02
    penetration: float = 0.03
    footprint: float = 0.0
    tilt: float = 30.0

    def __post_init__(self) -> None:
        if min(self.contact, self.penetration, self.footprint) < 0 or not 0 < self.tilt < 90:
            raise ValueError("contact limits must not be negative, tilt must be within 0..90")

    def within(self, near: float) -> bool:
        """Whether every contact is also near: the relation is a subset then."""
        return math.hypot(self.contact, self.footprint) <= near


REST = Contact()
WALL = Contact(penetration=0.02)
WALL_LOOSE = Contact(contact=0.12, penetration=0.02)


def shaped(pairs: DataFrame, surface: str = "s") -> bool:
    """Whether surfaces come with polygons; without, a surface is the rectangle of its box."""
    return "polygon" in pairs.schema[surface].dataType.fieldNames()


def measured(pairs: DataFrame, box: str = "e", surface: str = "s") -> DataFrame:
    """``pairs`` with ``side``, ``gap``, ``plane_gap`` and ``lean``: each measure is worked out once.

    Surfaces may be polygons; those of a table with polygons that have none take no part in contacts.
    """
    plane_gap = g.in_plane_gap(box, surface)
    if shaped(pairs, surface):
        pairs, plane_gap = pairs.where(g.col(surface, "polygon").isNotNull()), surface_gap(box, surface)
    return pairs.withColumns({"side": g.centroid_to_plane(box, surface), "gap": g.corner_range(box, surface)[0], "plane_gap": plane_gap, "lean": g.col(surface, "c")})


def verdict(rows: DataFrame, limits: Contact, wall: bool) -> DataFrame:
    """``rows`` of :func:`measured` with ``ok``, ``failed`` (clauses in order) and ``margin``.

    Wall contact asks for an upright surface, rest contact for a level one; both ask
    for the inner side, a gap within the band, and an overlap with the rectangle.
    """
    if wall:
        most = math.sin(math.radians(limits.tilt))
        name, capable, level = "wall_capable", F.abs("lean") <= most, (most - F.abs("lean")) / most
    else:
        least = math.cos(math.radians(limits.tilt))
        name, capable, level = "support_capable", F.col("lean") >= least, (F.col("lean") - least) / (1 - least)
    gap = F.col("gap")
    touching = (gap >= -limits.penetration) & (gap <= limits.contact)
    clauses = [(name, capable), ("centroid_on_support_side", F.col("side") >= 0), ("contact", touching), ("footprint_ok", F.col("plane_gap") <= limits.footprint)]
    scale = limits.contact or 1.0
    over = F.when(F.col("plane_gap") <= 0, math.inf).otherwise((limits.footprint - F.col("plane_gap")) / scale)
    ok = clauses[0][1]
    for _, clause in clauses[1:]:
        ok = ok & clause
    return rows.withColumns({
        "ok": ok,
        "failed": F.array_compact(F.array(*[F.when(~clause, F.lit(label)) for label, clause in clauses])),
        "margin": F.least(level, F.col("side") / scale, g.band_margin(gap, -limits.penetration, limits.contact), over),
    })


def rest_contact(pairs: DataFrame, limits: Contact = REST) -> DataFrame:
    """Whether ``e`` rests on the level surface ``s``."""
    return verdict(measured(pairs), limits, wall=False)


def wall_contact(pairs: DataFrame, limits: Contact = WALL) -> DataFrame:
    """Whether ``e`` touches the upright surface ``s`` from its inner side."""
    return verdict(measured(pairs), limits, wall=True)
