"""Distance joins of boxes by a grid, exact and without a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.sources.tables import apart


def _cells(df: DataFrame, low: list[Column], high: list[Column], cell: float, tag: str) -> DataFrame:
    """Rows once for each grid cell of their box; ``tag``0..2 is the first cell on each axis."""
    firsts = [F.floor(v / cell).cast("int") for v in low]
    lasts = [F.floor(v / cell).cast("int") for v in high]
    out = df.select("*", *[v.alias(f"{tag}{k}") for k, v in enumerate(firsts)], *[v.alias(f"{tag}_to{k}") for k, v in enumerate(lasts)])
    for k in range(3):
        out = out.withColumn(f"cell{k}", F.explode(F.sequence(F.col(f"{tag}{k}"), F.col(f"{tag}_to{k}"))))
    return out.drop(*[f"{tag}_to{k}" for k in range(3)])


def pairs_within(boxes: DataFrame, reach: float, cell: float | None = None, points: bool = False) -> DataFrame:
    """``scene_id, a, b``: pairs of one scene (a.ord < b.ord) whose boxes may be within ``reach``.

    Boxes (or centroids, with ``points``) on the left are widened by ``reach``; both
    sides are dealt to grid cells and joined on (scene, cell). A pair that shares
    several cells is kept in the first of them alone, so no distinct is needed. The
    caller applies the exact predicate. A scene of any size is spread over its cells.
    """
    cell = cell or max(2 * reach, 1.0)
    at = [F.col(f"c{k}") for k in g.AXES] if points else None
    low = at or [F.col(f"{k}0") for k in g.AXES]
    high = at or [F.col(f"{k}1") for k in g.AXES]
    left = _cells(boxes, [v - reach for v in low], [v + reach for v in high], cell, "m")
    right = _cells(boxes, low, high, cell, "n")
    fields = boxes.columns
    a = left.select("scene_id", "cell0", "cell1", "cell2", "m0", "m1", "m2", F.struct(*fields).alias("a"))
    b = right.select("scene_id", "cell0", "cell1", "cell2", "n0", "n1", "n2", F.struct(*fields).alias("b"))
    met = a.join(b, ["scene_id", "cell0", "cell1", "cell2"])
    first = (F.col("cell0") == F.greatest("m0", "n0")) & (F.col("cell1") == F.greatest("m1", "n1")) & (F.col("cell2") == F.greatest("m2", "n2"))
    return met.where((F.col("a.ord") < F.col("b.ord")) & first).select("scene_id", "a", "b")


def footprints_meeting(targets: DataFrame, under: DataFrame, cell: float = 1.0) -> DataFrame:
    """``scene_id, t, s``: rows of two tables of one scene whose footprints (x0, y0, x1, y1) meet, each pair once.

    Both sides are dealt to the cells of a grid and joined on (scene, cell); a pair that shares
    several cells is kept in the first of them.
    """

    def dealt(df: DataFrame, name: str) -> DataFrame:
        out = df.select("scene_id", *[F.col(c).alias(f"{name}_{c}") for c in df.columns])
        for k in "xy":
            first, last = (F.floor(F.col(f"{name}_{k}{n}") / cell) for n in (0, 1))
            out = out.withColumn(f"{name}_cell_{k}", first).withColumn(f"cell_{k}", F.explode(F.sequence(first, last)))
        return out

    met = dealt(targets, "t").join(apart(dealt(under, "s")), ["scene_id", "cell_x", "cell_y"])
    first = [F.col(f"cell_{k}") == F.greatest(f"t_cell_{k}", f"s_cell_{k}") for k in "xy"]
    touching = [F.col(f"{a}_{k}0") <= F.col(f"{b}_{k}1") for k in "xy" for a, b in ("ts", "st")]
    for clause in (*first, *touching):
        met = met.where(clause)
    # the rows are put together last, so that no field is read through the explosions above
    whole = lambda df, name: F.struct(*[F.col(f"{name}_{c}").alias(c) for c in df.columns]).alias(name)
    return met.select("scene_id", whole(targets, "t"), whole(under, "s"))
