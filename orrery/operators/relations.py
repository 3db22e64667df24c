"""Spatial relations between entities and surfaces, as edge tables.

Every extractor returns ``scene_id, src, type, dst, metric, margin`` (an edge table);
those that reject pairs for a reason also have a rejection table with ``reason``.
Order of entities (``ord``) decides the direction of symmetric edges.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import contact as c
from orrery.functions import geometry as g
from orrery.functions.polygon import box_to_surface, placed, surface_gap
from orrery.operators.boxjoin import pairs_within
from orrery.sources.tables import settled

EDGE = ["scene_id", "src", "type", "dst", "metric", "margin"]
#: Near limits by surface type, in metres.
NEAR_SURFACE = {"floor": 0.05, "wall": 0.30, "ceiling": 0.10}
CANONICAL = {"RIGHT_OF": "LEFT_OF", "IN_FRONT_OF": "BEHIND", "BELOW": "ABOVE", "CONTAINS": "INSIDE", "SUPPORTS": "ON_TOP_OF"}


def _edge(pairs: DataFrame, src: Column, kind: Column, dst: Column, metric: Column, margin: Column) -> DataFrame:
    return pairs.select("scene_id", src.alias("src"), kind.alias("type"), dst.alias("dst"), metric.alias("metric"), margin.alias("margin"))


def near(entities: DataFrame, limit: float = 1.0, boxes: bool = False, both_ways: bool = False) -> DataFrame:
    """NEAR edges: distance of centroids (or of boxes) below ``limit``; one edge a pair, or both directions."""
    distance = g.box_distance("a", "b") if boxes else g.centroid_distance("a", "b")
    pairs = pairs_within(entities, limit, points=not boxes).withColumn("d", distance).where(F.col("d") < limit)
    edges = _edge(pairs, F.col("a.uid"), F.lit("NEAR"), F.col("b.uid"), F.col("d"), g.ratio_margin(F.col("d"), F.lit(limit)))
    if both_ways:
        back = edges.select("scene_id", F.col("dst").alias("src"), "type", F.col("src").alias("dst"), "metric", "margin")
        edges = edges.unionByName(back)
    return edges


def _deltas() -> tuple[Column, Column, Column, Column]:
    dx, dy, dz = (F.col(f"a.c{k}") - F.col(f"b.c{k}") for k in g.AXES)
    return dx, dy, dz, F.greatest(F.abs(dx), F.abs(dy), F.abs(dz))


def directional_sparse(entities: DataFrame, reach: float = 2.5, least: float = 0.5) -> DataFrame:
    """One canonical edge (LEFT_OF, BEHIND or ABOVE) per pair within ``reach`` along its dominant axis.

    Ties of axes go to x, then y. The source is the entity of lower x or y, or of
    higher z.
    """
    dx, dy, dz, top = _deltas()
    near_by = g.centroid_distance("a", "b") <= reach
    pairs = pairs_within(entities, reach, points=True).where(near_by & (top >= least))
    kind = F.when(F.abs(dx) == top, "LEFT_OF").when(F.abs(dy) == top, "BEHIND").otherwise("ABOVE")
    first = F.when(F.abs(dx) == top, dx < 0).when(F.abs(dy) == top, dy < 0).otherwise(dz > 0)
    src, dst = F.when(first, F.col("a.uid")).otherwise(F.col("b.uid")), F.when(first, F.col("b.uid")).otherwise(F.col("a.uid"))
    return _edge(pairs, src, kind, dst, top, g.dominance_margin(dx, dy, dz, least))


def directional_compat(entities: DataFrame, least: float = 0.3) -> DataFrame:
    """All ordered pairs of a scene, with one of six directions along the dominant axis."""
    a = entities.select("scene_id", F.struct(*entities.columns).alias("a"))
    b = entities.select("scene_id", F.struct(*entities.columns).alias("b"))
    dx, dy, dz, top = _deltas()
    pairs = a.join(b, "scene_id").where((F.col("a.uid") != F.col("b.uid")) & (top >= least))
    kind = (
        F.when(F.abs(dx) == top, F.when(dx < 0, "LEFT_OF").otherwise("RIGHT_OF"))
        .when(F.abs(dy) == top, F.when(dy < 0, "BEHIND").otherwise("IN_FRONT_OF"))
        .otherwise(F.when(dz < 0, "BELOW").otherwise("ABOVE"))
    )
    return _edge(pairs, F.col("a.uid"), kind, F.col("b.uid"), top, g.dominance_margin(dx, dy, dz, least))


def with_surfaces(entities: DataFrame, surfaces: DataFrame, types: list[str] | None = None) -> DataFrame:
    """``scene_id, e, s``: entities with the surfaces of their scene, of some types; polygons are placed in their planes first."""
    kept = surfaces if types is None else surfaces.where(F.col("surface_type").isin(types))
    if "polygon" in kept.columns and "pane" not in kept.columns:
        kept = settled(placed(kept), "placed-surfaces")
    e = entities.select("scene_id", F.struct(*entities.columns).alias("e"))
    return e.join(kept.select("scene_id", F.struct(*kept.columns).alias("s")), "scene_id")


def near_surface(entities: DataFrame, surfaces: DataFrame, polygons: bool = False) -> DataFrame:
    """NEAR_SURFACE: distance to the plane, or to the rectangle or polygon in it, within the type's limit.

    A surface without a polygon, in a table that has them, is its whole plane.
    """
    limit = F.lit(None).cast("double")
    for kind, value in NEAR_SURFACE.items():
        limit = F.when(F.col("s.surface_type") == kind, value).otherwise(limit)
    distance = g.box_to_plane("e", "s")
    if polygons:
        exact = "polygon" in surfaces.columns
        distance = box_to_surface("e", "s")["distance"] if exact else g.root_sum(distance, g.in_plane_gap("e", "s"))
    pairs = with_surfaces(entities, surfaces).withColumn("d", distance).withColumn("limit", limit).where(F.col("d") <= F.col("limit"))
    return _edge(pairs, F.col("e.uid"), F.lit("NEAR_SURFACE"), F.col("s.surface"), F.col("d"), g.ratio_margin(F.col("d"), F.col("limit")))


def _tested(tests: DataFrame, kind: str, dst: str) -> DataFrame:
    return tests.select("scene_id", F.col("e.uid").alias("src"), F.lit(kind).alias("type"), F.col(dst).alias("dst"), F.col("gap").alias("metric"), "margin", "ok", "failed")


def on_surface_tests(entities: DataFrame, surfaces: DataFrame, limits: c.Contact = c.REST) -> DataFrame:
    """Every entity against every surface, with the verdict and the failed clauses in order."""
    return _tested(c.rest_contact(with_surfaces(entities, surfaces), limits), "ON_SURFACE", "s.surface")


def contacts_surface_tests(entities: DataFrame, surfaces: DataFrame, limits: c.Contact = c.WALL) -> DataFrame:
    return _tested(c.wall_contact(with_surfaces(entities, surfaces, ["wall"]), limits), "CONTACTS_SURFACE", "s.surface")


def edges_of(tests: DataFrame) -> DataFrame:
    return tests.where("ok").select(*EDGE)


def floor_rest(entities: DataFrame, surfaces: DataFrame, contact: float = 0.02) -> DataFrame:
    """``scene_id, uid, on_floor``: whether a floor carries the entity; the gap has no lower bound here."""
    pairs = with_surfaces(entities, surfaces, ["floor"])
    inside = F.coalesce(surface_gap("e", "s"), F.lit(math.inf)) if c.shaped(pairs) else g.in_plane_gap("e", "s")
    upright, side, over = F.col("s.c") >= math.cos(math.radians(30)), g.centroid_to_plane("e", "s") >= 0, inside <= 0
    carried = upright & side & over & (g.corner_range("e", "s")[0] <= contact)
    return pairs.groupBy("scene_id", F.col("e.uid").alias("uid")).agg(F.bool_or(carried).alias("on_floor"))


def attached_to(entities: DataFrame, surfaces: DataFrame) -> DataFrame:
    """ATTACHED_TO: touches a wall and is not carried by a floor."""
    touching = contacts_surface_tests(entities, surfaces).where("ok")
    free = floor_rest(entities, surfaces).where("not on_floor").select("scene_id", F.col("uid").alias("src"))
    return touching.join(free, ["scene_id", "src"], "left_semi").withColumn("type", F.lit("ATTACHED_TO")).select(*EDGE)


@dataclass(frozen=True)
class AttachedV2:
    depth: float = 0.35
    clearance: float = 0.30
    thin: float = 0.12


def attached_to_v2(entities: DataFrame, surfaces: DataFrame, cfg: AttachedV2 = AttachedV2()) -> DataFrame:
    """ATTACHED_TO, second form: loose wall contact, shallow, and clear of the first floor or thin; says which."""
    level = surfaces.where("surface_type = 'floor'").groupBy("scene_id").agg(F.min(F.struct("surface", "z0")).alias("f")).select("scene_id", F.col("f.z0").alias("floor_z"))
    low, high = g.corner_range("e", "s")
    tested = c.wall_contact(with_surfaces(entities, surfaces, ["wall"]).withColumn("depth", high - low), c.WALL_LOOSE)
    touching = tested.where(F.col("ok") & (F.col("depth") <= cfg.depth)).select(
        "scene_id", F.col("e.uid").alias("src"), F.lit("ATTACHED_TO").alias("type"), F.col("s.surface").alias("dst"), F.col("depth").alias("metric"), "margin", F.col("e.z0").alias("bottom"))
    clear = F.coalesce(F.col("bottom") - F.col("floor_z") >= cfg.clearance, F.lit(False))
    placed = touching.join(level, "scene_id", "left").withColumn("disjunct", F.when(clear, "clear").otherwise("thin"))
    return placed.where((F.col("disjunct") == "clear") | (F.col("metric") <= cfg.thin)).select(*EDGE, "disjunct")


def tops(entities: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Upper faces of furniture as surfaces, with their owner."""
    owned = entities.where(F.col("cls").isin(*classes))
    return owned.select(
        "scene_id", F.concat(F.lit("ent_surf_"), "uid", F.lit("_top")).alias("surface"), F.lit("entity_top").alias("surface_type"), F.col("uid").alias("owner"), F.col("cls").alias("owner_class"),
        F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("c"), (-F.col("z1")).alias("d"), "x0", "y0", F.col("z1").alias("z0"), "x1", "y1", "z1", g.footprint("").alias("area"), F.col("z0").alias("owner_z0"),
    )


def on_entity_surface_tests(entities: DataFrame, classes: tuple[str, ...], limits: c.Contact = c.REST) -> DataFrame:
    """Entities that carry nothing themselves against the tops of others in their scene."""
    movable = entities.where(~F.col("cls").isin(*classes))
    pairs = with_surfaces(movable, tops(entities, classes)).where(F.col("e.uid") != F.col("s.owner"))
    return _tested(c.rest_contact(pairs, limits), "ON_ENTITY_SURFACE", "s.owner")


def on_entity_surface_v2(entities: DataFrame, surfaces: DataFrame, classes: tuple[str, ...], most_area: float = 0.5) -> DataFrame:
    """Resting on a top, or contained: centre above the owner, small, bottom within the owner's height.

    Contained entities that a floor carries are left out, take the owner of least
    footprint (then least uid), and do not repeat a pair of the first kind.
    """
    rest = edges_of(on_entity_surface_tests(entities, classes)).withColumn("how", F.lit("rest"))
    movable = entities.where(~F.col("cls").isin(*classes) & (g.footprint("") <= most_area))
    free = floor_rest(movable, surfaces).where("not on_floor").select("scene_id", "uid")
    pairs = with_surfaces(movable.join(free, ["scene_id", "uid"], "left_semi"), tops(entities, classes))
    held = pairs.where((F.col("e.uid") != F.col("s.owner")) & g.inside_xy("e", "s") & (F.col("e.z0") >= F.col("s.owner_z0")) & (F.col("e.z0") <= F.col("s.z1") + 0.02))
    best = Window.partitionBy("scene_id", "e.uid").orderBy("s.area", "s.owner")
    first = held.withColumn("n", F.row_number().over(best)).where("n = 1")
    contained = _edge(first, F.col("e.uid"), F.lit("ON_ENTITY_SURFACE"), F.col("s.owner"), F.col("s.z1") - F.col("e.z0"), F.lit(0.0)).withColumn("how", F.lit("contained"))
    return rest.unionByName(contained.join(rest, ["scene_id", "src", "dst"], "left_anti"))


def sampled_rejections(tests: DataFrame, cap: int = 64) -> DataFrame:
    """At most ``cap`` rejections of each scene and relation: the nearest to acceptance, and some by policy.

    A rejection without a margin is one by policy. Those have a quarter of the cap in
    reserve, of which margins get what is unused, and the other way round. Margins go
    largest first; ties and policies in order of src, then dst. ``place`` is that order among the kept.
    """
    group = Window.partitionBy("scene_id", "type")
    policy = F.col("margin").isNull()
    ranked = tests.where("not ok").withColumns({
        "_policies": F.count_if(policy).over(group),
        "_measured": F.count_if(~policy).over(group),
        "_n": F.row_number().over(Window.partitionBy("scene_id", "type", policy).orderBy(F.desc("margin"), "src", "dst")),
    })
    measured = F.least(F.col("_measured"), cap - F.least(F.col("_policies"), F.lit(cap // 4)))
    kept = ranked.where(F.col("_n") <= F.when(policy, F.least(F.col("_policies"), cap - measured)).otherwise(measured))
    return kept.withColumn("place", F.row_number().over(group.orderBy("src", "dst"))).drop("_policies", "_measured", "_n")


def with_edge_id(edges: DataFrame, extractor: str, version: str) -> DataFrame:
    """Edges with a content-addressed id."""
    key = F.concat_ws("|", F.lit(extractor), F.lit(version), "scene_id", "src", "type", "dst")
    return edges.withColumn("edge_id", F.concat(F.lit("e_"), F.substring(F.sha2(key, 256), 1, 16)))


def logical_key() -> Column:
    """What counts as one edge: symmetric pairs in either order, inverses as their canonical type."""
    canonical = F.col("type")
    for inverse, kept in CANONICAL.items():
        canonical = F.when(F.col("type") == inverse, kept).otherwise(canonical)
    swap = F.when(F.col("type") == "NEAR", F.col("src") > F.col("dst")).otherwise(F.col("type").isin(*CANONICAL))
    a, b = F.when(swap, F.col("dst")).otherwise(F.col("src")), F.when(swap, F.col("src")).otherwise(F.col("dst"))
    return F.struct(canonical.alias("type"), a.alias("src"), b.alias("dst"))


def violations(edges: DataFrame, entities: DataFrame, surfaces: DataFrame) -> DataFrame:
    """``check, n``: duplicate edges, unknown sources and targets, duplicate uids; n is 0 when a graph is sound."""
    known = entities.select("scene_id", F.col("uid").alias("ref"))
    ends = known.unionByName(surfaces.select("scene_id", F.col("surface").alias("ref")))
    twice = edges.groupBy("scene_id", "src", "type", "dst").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_edge").alias("check"), "n")
    lost = edges.join(known.withColumnRenamed("ref", "src"), ["scene_id", "src"], "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown_source").alias("check"), "n")
    blind = edges.join(ends.withColumnRenamed("ref", "dst"), ["scene_id", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown_target").alias("check"), "n")
    same = entities.groupBy("scene_id", "uid").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_uid").alias("check"), "n")
    return twice.unionByName(lost).unionByName(blind).unionByName(same)
