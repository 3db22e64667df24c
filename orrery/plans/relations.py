"""Queries over the derived relations, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import contact as c
from orrery.functions import geometry as g
from orrery.operators import relations as r
from orrery.plans.scene import PRELUDE, SUPPORT, entities, surfaces
from orrery.sources.tables import settled

_SUPPORT_SQL = ", ".join(f"'{x}'" for x in SUPPORT)


def shown(edges: DataFrame, *more: str) -> DataFrame:
    """Edges as queries return them: metric and confidence rounded."""
    confidence = F.round(g.margin_confidence(F.col("margin")), 6)
    return edges.select("scene_id", "src", "type", "dst", F.round("metric", 6).alias("metric"), confidence.alias("confidence"), *more)


def _confidence(margin: str) -> str:
    return f"round(1 / (1 + exp(-least(greatest(4 * ({margin}), -50e0), 50e0))), 6)"


_GAP = "greatest(0e0, {a}.{k}0 - {b}.{k}1, {b}.{k}0 - {a}.{k}1)"
_CDIST = "sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2)"
_BDIST = "sqrt(" + " + ".join(_GAP.format(a="a", b="b", k=k) + " ** 2" for k in "xyz") + ")"
_PAIR = "FROM ent a JOIN ent b ON a.scene_id = b.scene_id AND a.ord < b.ord"
#: Corner range, centroid side and in-plane gap of entity e and surface s.
TESTED = PRELUDE + """, es AS (
  SELECT e.scene_id, e.uid, e.ord, e.cls, s.*  EXCLUDE (scene_id, x0, y0, z0, x1, y1, z1), s.z0 AS sz0, e.x0, e.y0, e.z0, e.x1, e.y1, e.z1,
    s.a * e.cx + s.b * e.cy + s.c * e.cz + s.d AS side,
    s.a * (e.x0 + e.x1) / 2 + s.b * (e.y0 + e.y1) / 2 + s.c * (e.z0 + e.z1) / 2 + s.d AS mid,
    abs(s.a) * (e.x1 - e.x0) / 2 + abs(s.b) * (e.y1 - e.y0) / 2 + abs(s.c) * (e.z1 - e.z0) / 2 AS reach,
    sqrt((CASE WHEN abs(s.a) > 0.5 THEN 0 ELSE greatest(0e0, e.x0 - s.x1, s.x0 - e.x1) END) ** 2 + (CASE WHEN abs(s.b) > 0.5 THEN 0 ELSE greatest(0e0, e.y0 - s.y1, s.y0 - e.y1) END) ** 2
       + (CASE WHEN abs(s.c) > 0.5 THEN 0 ELSE greatest(0e0, e.z0 - s.z1, s.z0 - e.z1) END) ** 2) AS plane_gap
  FROM ent e JOIN surf s USING (scene_id)
), tests AS (
  SELECT *, mid - reach AS gap, CASE WHEN mid - reach <= 0 AND mid + reach >= 0 THEN 0 ELSE least(abs(mid - reach), abs(mid + reach)) END AS distance,
    c >= cos(radians(30)) AS level, abs(c) <= sin(radians(30)) AS upright FROM es
)"""


def _contact_margin(orientation: str, contact: float, penetration: float) -> str:
    band = f"least(gap + {penetration}e0, {contact}e0 - gap) / {(contact + penetration) / 2}e0"
    return f"least({orientation}, side / {contact}e0, {band}, CASE WHEN plane_gap <= 0 THEN 'infinity'::DOUBLE ELSE -plane_gap / {contact}e0 END)"


_REST = _contact_margin("(c - cos(radians(30))) / (1 - cos(radians(30)))", 0.02, 0.03)
_WALL = _contact_margin("(sin(radians(30)) - abs(c)) / sin(radians(30))", 0.02, 0.02)
_LOOSE = _contact_margin("(sin(radians(30)) - abs(c)) / sin(radians(30))", 0.12, 0.02)
_REST_OK = "level AND side >= 0 AND gap >= -0.03e0 AND gap <= 0.02e0 AND plane_gap <= 0"
_WALL_OK = "surface_type = 'wall' AND upright AND side >= 0 AND gap >= -0.02e0 AND gap <= 0.02e0 AND plane_gap <= 0"
_LOOSE_OK = "surface_type = 'wall' AND upright AND side >= 0 AND gap >= -0.02e0 AND gap <= 0.12e0 AND plane_gap <= 0"
_FREE = "(SELECT scene_id, uid FROM tests WHERE surface_type = 'floor' GROUP BY ALL HAVING NOT bool_or(level AND side >= 0 AND plane_gap <= 0 AND gap <= 0.02e0))"
#: Tops of furniture and the entities tested against them.
TOPS = TESTED + f""", top AS (SELECT scene_id, uid AS owner, -z1 AS d, x0, y0, x1, y1, z0, z1, (x1 - x0) * (y1 - y0) AS area FROM ent WHERE cls IN ({_SUPPORT_SQL})
), et AS (
  SELECT e.scene_id, e.uid, t.owner, t.area, 1e0 AS c, e.cz + t.d AS side, (e.z0 + e.z1) / 2 + t.d - (e.z1 - e.z0) / 2 AS gap,
    sqrt(greatest(0e0, e.x0 - t.x1, t.x0 - e.x1) ** 2 + greatest(0e0, e.y0 - t.y1, t.y0 - e.y1) ** 2) AS plane_gap,
    e.cx BETWEEN t.x0 AND t.x1 AND e.cy BETWEEN t.y0 AND t.y1 AND e.z0 >= t.z0 AND e.z0 <= t.z1 + 0.02e0 AND (e.x1 - e.x0) * (e.y1 - e.y0) <= 0.5 AS held, t.z1 - e.z0 AS sunk
  FROM ent e JOIN top t ON e.scene_id = t.scene_id AND e.uid <> t.owner WHERE e.cls NOT IN ({_SUPPORT_SQL})
), et_ok AS (SELECT *, side >= 0 AND gap >= -0.03e0 AND gap <= 0.02e0 AND plane_gap <= 0 AS ok FROM et)"""
_EDGE = "scene_id, uid AS src, '{t}' AS type, {d} AS dst, round({m}, 6) AS metric, {c} AS confidence"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@_query(f"WITH {PRELUDE}, p AS (SELECT a.scene_id, a.uid AS src, b.uid AS dst, {_CDIST} AS d {_PAIR}) SELECT scene_id, src, 'NEAR' AS type, dst, round(d, 6) AS metric, {_confidence('1 - d')} AS confidence FROM p WHERE d < 1")
def near_v1_edges(spark: SparkSession, sf: str) -> DataFrame:
    return shown(r.near(entities(spark, sf)))


@_query(f"WITH {PRELUDE}, p AS (SELECT a.scene_id, a.uid AS src, b.uid AS dst, {_BDIST} AS d {_PAIR}) SELECT scene_id, src, 'NEAR' AS type, dst, round(d, 6) AS metric, {_confidence('1 - d')} AS confidence FROM p WHERE d < 1")
def near_v2_edges(spark: SparkSession, sf: str) -> DataFrame:
    return shown(r.near(entities(spark, sf), boxes=True))


@_query(f"WITH {PRELUDE}, p AS (SELECT a.scene_id, a.uid AS src, b.uid AS dst, {_CDIST} AS d FROM ent a JOIN ent b ON a.scene_id = b.scene_id AND a.ord <> b.ord) SELECT scene_id, src, 'NEAR' AS type, dst, round(d, 6) AS metric, {_confidence('1 - d')} AS confidence FROM p WHERE d < 1")
def near_compat_edges(spark: SparkSession, sf: str) -> DataFrame:
    return shown(r.near(entities(spark, sf), both_ways=True))


_DELTA = "a.cx - b.cx AS dx, a.cy - b.cy AS dy, a.cz - b.cz AS dz, greatest(abs(a.cx - b.cx), abs(a.cy - b.cy), abs(a.cz - b.cz)) AS top"
_RUNNER = "list_sort([abs(dx), abs(dy), abs(dz)])[2]"


@_query(f"""WITH {PRELUDE}, p AS (SELECT a.scene_id, a.uid AS a, b.uid AS b, {_DELTA} {_PAIR} AND {_CDIST} <= 2.5),
q AS (SELECT *, CASE WHEN abs(dx) = top THEN 'LEFT_OF' WHEN abs(dy) = top THEN 'BEHIND' ELSE 'ABOVE' END AS type,
  CASE WHEN abs(dx) = top THEN dx < 0 WHEN abs(dy) = top THEN dy < 0 ELSE dz > 0 END AS fwd FROM p WHERE top >= 0.5)
SELECT scene_id, CASE WHEN fwd THEN a ELSE b END AS src, type, CASE WHEN fwd THEN b ELSE a END AS dst, round(top, 6) AS metric, {_confidence(f'(top - greatest(0.5e0, {_RUNNER})) / 0.5e0')} AS confidence FROM q""")
def directional_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return shown(r.directional_sparse(entities(spark, sf)))


@_query(f"""WITH {PRELUDE}, p AS (SELECT a.scene_id, a.uid AS src, b.uid AS dst, {_DELTA} FROM ent a JOIN ent b ON a.scene_id = b.scene_id AND a.ord <> b.ord)
SELECT scene_id, src, CASE WHEN abs(dx) = top THEN CASE WHEN dx < 0 THEN 'LEFT_OF' ELSE 'RIGHT_OF' END WHEN abs(dy) = top THEN CASE WHEN dy < 0 THEN 'BEHIND' ELSE 'IN_FRONT_OF' END
  ELSE CASE WHEN dz < 0 THEN 'BELOW' ELSE 'ABOVE' END END AS type, dst, round(top, 6) AS metric, {_confidence(f'(top - greatest(0.3e0, {_RUNNER})) / 0.3e0')} AS confidence FROM p WHERE top >= 0.3""")
def directional_compat(spark: SparkSession, sf: str) -> DataFrame:
    return shown(r.directional_compat(entities(spark, sf)))


_LIMIT = "CASE surface_type WHEN 'floor' THEN 0.05e0 WHEN 'wall' THEN 0.30e0 ELSE 0.10e0 END"


@_query(f"WITH {TESTED} SELECT {_EDGE.format(t='NEAR_SURFACE', d='surface', m='distance', c=_confidence(f'({_LIMIT} - distance) / {_LIMIT}'))} FROM tests WHERE distance <= {_LIMIT}")
def near_surface_plane(spark: SparkSession, sf: str) -> DataFrame:
    return shown(r.near_surface(entities(spark, sf), surfaces(spark, sf)))


@_query(f"WITH {TESTED}, f AS (SELECT *, sqrt(distance ** 2 + plane_gap ** 2) AS full_distance FROM tests) SELECT {_EDGE.format(t='NEAR_SURFACE', d='surface', m='full_distance', c=_confidence(f'({_LIMIT} - full_distance) / {_LIMIT}'))} FROM f WHERE full_distance <= {_LIMIT}")
def near_surface_rect(spark: SparkSession, sf: str) -> DataFrame:
    return shown(r.near_surface(entities(spark, sf), surfaces(spark, sf), polygons=True))


@_query(f"WITH {TESTED} SELECT {_EDGE.format(t='ON_SURFACE', d='surface', m='gap', c=_confidence(_REST))} FROM tests WHERE {_REST_OK}")
def on_surface(spark: SparkSession, sf: str) -> DataFrame:
    return shown(r.edges_of(r.on_surface_tests(entities(spark, sf), surfaces(spark, sf))))


@_query(f"WITH {TESTED} SELECT {_EDGE.format(t='CONTACTS_SURFACE', d='surface', m='gap', c=_confidence(_WALL))} FROM tests WHERE {_WALL_OK}")
def contacts_surface(spark: SparkSession, sf: str) -> DataFrame:
    return shown(r.edges_of(r.contacts_surface_tests(entities(spark, sf), surfaces(spark, sf))))


@_query(f"WITH {TESTED} SELECT {_EDGE.format(t='ATTACHED_TO', d='surface', m='gap', c=_confidence(_WALL))} FROM tests SEMI JOIN {_FREE} f USING (scene_id, uid) WHERE {_WALL_OK}")
def attached_to(spark: SparkSession, sf: str) -> DataFrame:
    return shown(r.attached_to(entities(spark, sf), surfaces(spark, sf)))


@_query(f"WITH {TESTED} SELECT {_EDGE.format(t='ATTACHED_TO', d='surface', m='2 * reach', c=_confidence(_LOOSE))}, CASE WHEN z0 >= 0.3e0 THEN 'clear' ELSE 'thin' END AS disjunct FROM tests WHERE {_LOOSE_OK} AND 2 * reach <= 0.35e0 AND (z0 >= 0.3e0 OR 2 * reach <= 0.12e0)")
def attached_to_v2(spark: SparkSession, sf: str) -> DataFrame:
    return shown(r.attached_to_v2(entities(spark, sf), surfaces(spark, sf)), "disjunct")


@_query(f"WITH {TOPS} SELECT {_EDGE.format(t='ON_ENTITY_SURFACE', d='owner', m='gap', c=_confidence(_contact_margin('1e0', 0.02, 0.03)))} FROM et_ok WHERE ok")
def on_entity_surface(spark: SparkSession, sf: str) -> DataFrame:
    return shown(r.edges_of(r.on_entity_surface_tests(entities(spark, sf), SUPPORT)))


@_query(f"""WITH {TOPS}, held AS (SELECT * FROM et SEMI JOIN {_FREE} f USING (scene_id, uid) WHERE held QUALIFY row_number() OVER (PARTITION BY scene_id, uid ORDER BY area, owner) = 1)
SELECT {_EDGE.format(t='ON_ENTITY_SURFACE', d='owner', m='gap', c=_confidence(_contact_margin('1e0', 0.02, 0.03)))}, 'rest' AS how FROM et_ok WHERE ok
UNION ALL SELECT scene_id, uid, 'ON_ENTITY_SURFACE', owner, round(sunk, 6), 0.5e0, 'contained' FROM held h ANTI JOIN (SELECT * FROM et_ok WHERE ok) r USING (scene_id, uid, owner)""")
def on_entity_surface_v2(spark: SparkSession, sf: str) -> DataFrame:
    return shown(r.on_entity_surface_v2(entities(spark, sf), surfaces(spark, sf), SUPPORT), "how")


_FAILED = "list_filter([CASE WHEN NOT {cap} THEN '{name}' END, CASE WHEN NOT side >= 0 THEN 'centroid_on_support_side' END, CASE WHEN NOT (gap >= -{pen}e0 AND gap <= 0.02e0) THEN 'contact' END, CASE WHEN NOT plane_gap <= 0 THEN 'footprint_ok' END], lambda x: x IS NOT NULL)"


@_query(f"""WITH {TESTED}, f AS (
  SELECT scene_id, 'ON_SURFACE' AS type, {_FAILED.format(cap='level', name='support_capable', pen=0.03)} AS failed FROM tests
  UNION ALL SELECT scene_id, 'CONTACTS_SURFACE', {_FAILED.format(cap='upright', name='wall_capable', pen=0.02)} FROM tests WHERE surface_type = 'wall')
SELECT scene_id, type, array_to_string(failed, '+') AS reason, count(*) AS n FROM f WHERE len(failed) > 0 GROUP BY ALL""")
def rejections_by_reason(spark: SparkSession, sf: str) -> DataFrame:
    e, s = entities(spark, sf), surfaces(spark, sf)
    tests = r.on_surface_tests(e, s).unionByName(r.contacts_surface_tests(e, s)).where("not ok")
    return tests.groupBy("scene_id", "type", F.array_join("failed", "+").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"""WITH {TESTED}, m AS (SELECT scene_id, uid AS src, surface AS dst, {_REST} AS margin FROM tests WHERE NOT ({_REST_OK}))
SELECT scene_id, src, dst, round(margin, 6) AS margin FROM m QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY margin DESC, src, dst) <= 64""")
def rejection_sample(spark: SparkSession, sf: str) -> DataFrame:
    tests = r.on_surface_tests(entities(spark, sf), surfaces(spark, sf))
    return r.sampled_rejections(tests).select("scene_id", "src", "dst", F.round("margin", 6).alias("margin"))


#: Rejections of three relations: measured ones, and CONTACTS_SURFACE's by policy, of surfaces that are no walls.
REJECTED = f"""rejected AS (
  SELECT scene_id, 'ON_SURFACE' AS type, uid AS src, surface AS dst, {_REST} AS margin FROM tests WHERE NOT ({_REST_OK})
  UNION ALL SELECT scene_id, 'CONTACTS_SURFACE', uid, surface, CASE WHEN surface_type = 'wall' THEN {_WALL} END FROM tests WHERE NOT ({_WALL_OK})
  UNION ALL SELECT scene_id, 'ON_ENTITY_SURFACE', uid, owner, {_contact_margin('1e0', 0.02, 0.03)} FROM et_ok WHERE NOT ok
), told AS (SELECT *, count(*) FILTER (margin IS NULL) OVER g AS policies, count(margin) OVER g AS measured, row_number() OVER (PARTITION BY scene_id, type, margin IS NULL ORDER BY margin DESC, src, dst) AS n FROM rejected WINDOW g AS (PARTITION BY scene_id, type)
), taken AS (SELECT *, least(measured, 64 - least(policies, 16)) AS take FROM told
), sampled AS (SELECT scene_id, type, src, dst, margin, row_number() OVER (PARTITION BY scene_id, type ORDER BY src, dst) AS place FROM taken WHERE n <= CASE WHEN margin IS NULL THEN least(policies, 64 - take) ELSE take END)"""


def rejections(e: DataFrame, s: DataFrame) -> DataFrame:
    """The sampled rejections of three relations."""
    rest, held = r.on_surface_tests(e, s), r.on_entity_surface_tests(e, SUPPORT)
    other = r.with_surfaces(e, s).where("s.surface_type <> 'wall'").select("scene_id", F.col("e.uid").alias("src"), F.lit("CONTACTS_SURFACE").alias("type"), F.col("s.surface").alias("dst"), F.lit(None).cast("double").alias("margin"), F.lit(False).alias("ok"))
    columns = other.columns
    every = rest.select(columns).unionByName(r.contacts_surface_tests(e, s).select(columns)).unionByName(held.select(columns)).unionByName(other)
    return r.sampled_rejections(every)


@_query(f"WITH {TOPS}, {REJECTED} SELECT scene_id, type, src, dst, round(margin, 6) AS margin, place FROM sampled")
def rejection_reserve(spark: SparkSession, sf: str) -> DataFrame:
    """Sampled rejections, near-misses and those by policy, in the order they were met."""
    found = rejections(settled(entities(spark, sf), "entities"), surfaces(spark, sf))
    return found.select("scene_id", "type", "src", "dst", F.round("margin", 6).alias("margin"), F.col("place").cast("long"))


def stored_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The graph's edges: seven extractors, each edge with its id. Entities are derived once and settled."""
    return edges_between(settled(entities(spark, sf), "entities"), surfaces(spark, sf))


#: The relations that a question may consult, by extractor.
_CONSULTED = {
    "directional": ("LEFT_OF", "RIGHT_OF", "BEHIND", "IN_FRONT_OF", "ABOVE", "BELOW"), "proximity": ("NEAR",), "near_surface": ("NEAR_SURFACE",), "on_surface": ("SUPPORTS", "ON_SURFACE"),
    "contacts_surface": ("CONTACTS_SURFACE",), "on_entity_surface": ("SUPPORTS", "ON_ENTITY_SURFACE"), "attached_to": ("ATTACHED_TO",),
}


def edges_between(e: DataFrame, s: DataFrame, consulted: set[str] | None = None) -> DataFrame:
    """The edges of all extractors, or of those that can say something on the relations ``consulted``."""
    parts = {
        "directional": lambda: r.directional_sparse(e),
        "proximity": lambda: r.near(e, boxes=True),
        "near_surface": lambda: r.near_surface(e, s, polygons=True),
        "on_surface": lambda: r.edges_of(r.on_surface_tests(e, s)),
        "contacts_surface": lambda: r.edges_of(r.contacts_surface_tests(e, s)),
        "on_entity_surface": lambda: r.edges_of(r.on_entity_surface_tests(e, SUPPORT)),
        "attached_to": lambda: r.attached_to(e, s),
    }
    found = None
    for name, edges in parts.items():
        if consulted is None or consulted.intersection(_CONSULTED[name]):
            own = r.with_edge_id(edges(), name, "1").withColumn("extractor", F.lit(name))
            found = own if found is None else found.unionByName(own)
    return found


#: The same edges in SQL, as a CTE ``edges`` (scene_id, src, type, dst, margin, extractor, edge_id).
EDGES = TOPS + f""", dirs AS (SELECT a.scene_id, a.uid AS a, b.uid AS b, {_DELTA} {_PAIR} AND {_CDIST} <= 2.5
), dir2 AS (SELECT *, CASE WHEN abs(dx) = top THEN 'LEFT_OF' WHEN abs(dy) = top THEN 'BEHIND' ELSE 'ABOVE' END AS type, CASE WHEN abs(dx) = top THEN dx < 0 WHEN abs(dy) = top THEN dy < 0 ELSE dz > 0 END AS fwd FROM dirs WHERE top >= 0.5
), unnamed AS (
  SELECT scene_id, CASE WHEN fwd THEN a ELSE b END AS src, type, CASE WHEN fwd THEN b ELSE a END AS dst, (top - greatest(0.5e0, {_RUNNER})) / 0.5e0 AS margin, 'directional' AS extractor FROM dir2
  UNION ALL SELECT scene_id, src, 'NEAR', dst, 1 - d, 'proximity' FROM (SELECT a.scene_id, a.uid AS src, b.uid AS dst, {_BDIST} AS d {_PAIR}) WHERE d < 1
  UNION ALL SELECT scene_id, uid, 'NEAR_SURFACE', surface, ({_LIMIT} - sqrt(distance ** 2 + plane_gap ** 2)) / {_LIMIT}, 'near_surface' FROM tests WHERE sqrt(distance ** 2 + plane_gap ** 2) <= {_LIMIT}
  UNION ALL SELECT scene_id, uid, 'ON_SURFACE', surface, {_REST}, 'on_surface' FROM tests WHERE {_REST_OK}
  UNION ALL SELECT scene_id, uid, 'CONTACTS_SURFACE', surface, {_WALL}, 'contacts_surface' FROM tests WHERE {_WALL_OK}
  UNION ALL SELECT scene_id, uid, 'ON_ENTITY_SURFACE', owner, {_contact_margin('1e0', 0.02, 0.03)}, 'on_entity_surface' FROM et_ok WHERE ok
  UNION ALL SELECT scene_id, uid, 'ATTACHED_TO', surface, {_WALL}, 'attached_to' FROM tests SEMI JOIN {_FREE} f USING (scene_id, uid) WHERE {_WALL_OK}
), edges AS (SELECT *, 'e_' || sha256(concat_ws('|', extractor, '1', scene_id, src, type, dst))[1:16] AS edge_id FROM unnamed)"""


@_query(f"WITH {EDGES} SELECT scene_id, src, type, dst, extractor, edge_id, {_confidence('margin')} AS confidence FROM edges")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return stored_edges(spark, sf).select("scene_id", "src", "type", "dst", "extractor", "edge_id", F.round(g.margin_confidence(F.col("margin")), 6).alias("confidence"))


@_query(f"""WITH {EDGES}, c AS (SELECT scene_id, count(*) AS stored, count(DISTINCT CASE WHEN type = 'NEAR' THEN (type, least(src, dst), greatest(src, dst)) ELSE (type, src, dst) END) AS logical FROM edges GROUP BY 1),
n AS (SELECT scene_id, count(*) AS entities FROM ent GROUP BY 1) SELECT scene_id, entities, stored, logical, round(logical / entities, 6) AS density, logical / entities > 14 AS blocked FROM n JOIN c USING (scene_id)""")
def graph_density(spark: SparkSession, sf: str) -> DataFrame:
    counts = stored_edges(spark, sf).groupBy("scene_id").agg(F.count(F.lit(1)).alias("stored"), F.countDistinct(r.logical_key()).alias("logical"))
    sizes = entities(spark, sf).groupBy("scene_id").agg(F.count(F.lit(1)).alias("entities"))
    density = F.col("logical") / F.col("entities")
    return sizes.join(counts, "scene_id").select("scene_id", "entities", "stored", "logical", F.round(density, 6).alias("density"), (density > 14).alias("blocked"))


@_query(f"WITH {EDGES} SELECT scene_id, extractor, type, count(*) AS n, round(avg({_confidence('margin')}), 4) AS mean_confidence FROM edges GROUP BY ALL")
def graph_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    confidence = F.round(g.margin_confidence(F.col("margin")), 6)
    return stored_edges(spark, sf).groupBy("scene_id", "extractor", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(confidence), 4).alias("mean_confidence"))


@_query(f"""WITH {EDGES} SELECT 'duplicate_edge' AS "check", count(*) AS n FROM (SELECT 1 FROM edges GROUP BY scene_id, src, type, dst HAVING count(*) > 1)
UNION ALL SELECT 'unknown_source', count(*) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM ent x WHERE x.scene_id = e.scene_id AND x.uid = e.src)
UNION ALL SELECT 'unknown_target', count(*) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM ent x WHERE x.scene_id = e.scene_id AND x.uid = e.dst) AND NOT EXISTS (SELECT 1 FROM surf x WHERE x.scene_id = e.scene_id AND x.surface = e.dst)
UNION ALL SELECT 'duplicate_uid', count(*) FROM (SELECT 1 FROM ent GROUP BY scene_id, uid HAVING count(*) > 1)""")
def build_violations(spark: SparkSession, sf: str) -> DataFrame:
    return r.violations(stored_edges(spark, sf), entities(spark, sf), surfaces(spark, sf))


@_query(f"WITH {EDGES} SELECT scene_id, dst AS supporter, src AS supported, edge_id AS derived_from, CASE type WHEN 'ON_SURFACE' THEN 'surface' ELSE 'entity' END AS supporter_kind FROM edges WHERE type IN ('ON_SURFACE', 'ON_ENTITY_SURFACE')")
def support_view(spark: SparkSession, sf: str) -> DataFrame:
    return support_facts(stored_edges(spark, sf))


def support_facts(edges: DataFrame) -> DataFrame:
    """The support view: what carries what, from the edge that says so."""
    kind = F.when(F.col("type") == "ON_SURFACE", "surface").otherwise("entity")
    return edges.where(F.col("type").isin("ON_SURFACE", "ON_ENTITY_SURFACE")).select("scene_id", F.col("dst").alias("supporter"), F.col("src").alias("supported"), F.col("edge_id").alias("derived_from"), kind.alias("supporter_kind"))


@_query(f"""WITH {PRELUDE}, p AS (SELECT a.scene_id, {_CDIST} < 1 AS v1, {_BDIST} < 1 AS v2 {_PAIR})
SELECT scene_id, count(*) FILTER (v1 AND v2) AS both, count(*) FILTER (v1 AND NOT v2) AS only_v1, count(*) FILTER (v2 AND NOT v1) AS only_v2 FROM p WHERE v1 OR v2 GROUP BY 1""")
def relation_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that two forms of a relation share or not, by full outer join."""
    e = entities(spark, sf)
    one = r.near(e).select("scene_id", "src", "dst", F.lit(True).alias("v1"))
    two = r.near(e, boxes=True).select("scene_id", "src", "dst", F.lit(True).alias("v2"))
    both = one.join(two, ["scene_id", "src", "dst"], "full")
    has, new = F.col("v1").isNotNull(), F.col("v2").isNotNull()
    return both.groupBy("scene_id").agg(F.count_if(has & new).alias("both"), F.count_if(has & ~new).alias("only_v1"), F.count_if(new & ~has).alias("only_v2"))


@_query(f"""WITH {PRELUDE}, p AS (SELECT a.scene_id, {_BDIST} AS d {_PAIR}), k AS (SELECT unnest([0.5e0, 0.75e0, 1e0, 1.25e0, 1.5e0]) AS factor)
SELECT factor, scene_id, count(*) AS edges, count(*) FILTER (d >= 1) AS added, (SELECT count(*) FROM p q WHERE q.scene_id = p.scene_id AND q.d < 1 AND q.d >= factor) AS removed FROM p, k WHERE d < factor GROUP BY ALL""")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Edges gained and lost as the NEAR limit is scaled: one pass over the pairs of the widest limit."""
    factors = [0.5, 0.75, 1.0, 1.25, 1.5]
    pairs = r.near(entities(spark, sf), limit=max(factors), boxes=True).select("scene_id", F.col("metric").alias("d"))
    grid = pairs.select("*", F.explode(F.array(*map(F.lit, factors))).alias("factor"))
    d, factor = F.col("d"), F.col("factor")
    return grid.groupBy("factor", "scene_id").agg(F.count_if(d < factor).alias("edges"), F.count_if((d < factor) & (d >= 1)).alias("added"), F.count_if((d < 1) & (d >= factor)).alias("removed")).where("edges > 0")


@_query(f"""WITH {PRELUDE}, m AS (SELECT a.scene_id, a.uid AS a, b.uid AS b, {_DELTA} {_PAIR}),
t AS (SELECT *, cos(radians(30)) * dx - sin(radians(30)) * dy AS tx, sin(radians(30)) * dx + cos(radians(30)) * dy AS ty FROM m),
k AS (SELECT scene_id, CASE WHEN abs(dx) = top THEN CASE WHEN dx < 0 THEN 'LEFT_OF' ELSE 'RIGHT_OF' END WHEN abs(dy) = top THEN CASE WHEN dy < 0 THEN 'BEHIND' ELSE 'IN_FRONT_OF' END ELSE CASE WHEN dz < 0 THEN 'BELOW' ELSE 'ABOVE' END END AS before,
  CASE WHEN abs(tx) >= greatest(abs(ty), abs(dz)) THEN CASE WHEN tx < 0 THEN 'LEFT_OF' ELSE 'RIGHT_OF' END WHEN abs(ty) >= abs(dz) THEN CASE WHEN ty < 0 THEN 'BEHIND' ELSE 'IN_FRONT_OF' END ELSE CASE WHEN dz < 0 THEN 'BELOW' ELSE 'ABOVE' END END AS after FROM t)
SELECT before, after, count(*) AS n FROM k GROUP BY ALL""")
def frame_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """How directions change when the scene's frame is turned by 30 degrees."""
    e = entities(spark, sf)
    a, b = e.select("scene_id", F.struct("ord", "cx", "cy", "cz").alias("a")), e.select("scene_id", F.struct("ord", "cx", "cy", "cz").alias("b"))
    dx, dy, dz = (F.col(f"a.c{k}") - F.col(f"b.c{k}") for k in g.AXES)
    cos, sin = F.cos(F.radians(F.lit(30.0))), F.sin(F.radians(F.lit(30.0)))

    def kind(x, y, z):
        horizontal = F.when(F.abs(x) >= F.greatest(F.abs(y), F.abs(z)), F.when(x < 0, "LEFT_OF").otherwise("RIGHT_OF"))
        return horizontal.when(F.abs(y) >= F.abs(z), F.when(y < 0, "BEHIND").otherwise("IN_FRONT_OF")).otherwise(F.when(z < 0, "BELOW").otherwise("ABOVE"))

    pairs = a.join(b, "scene_id").where("a.ord < b.ord")
    return pairs.select(kind(dx, dy, dz).alias("before"), kind(cos * dx - sin * dy, sin * dx + cos * dy, dz).alias("after")).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))
