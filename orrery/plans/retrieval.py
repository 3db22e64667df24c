"""Label retrieval and mesh queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.operators import legacy, mesh
from orrery.operators import relations as r
from orrery.plans import relations as rel
from orrery.plans.scene import CLASSES, PRELUDE, entities
from orrery.sources.tables import settled

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ASKED = tuple(f"objects {phrase} the {label}" for phrase, label in (("left of", "table"), ("right of", "sofa"), ("in front of", "desk"), ("behind", "chair"), ("below", "lamp"), ("above", "table"), ("near", "shelf"))) + ("find the lamp", "what is here")


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def scored(spark: SparkSession, sf: str, version: int) -> DataFrame:
    e = settled(entities(spark, sf), "entities")
    asked = legacy.parse(spark.createDataFrame([(t,) for t in ASKED], "query string"), CLASSES)
    spots = e.select("scene_id", F.col("uid").alias("dst"), F.col("cls").alias("anchor"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    edges = r.directional_compat(e).select("scene_id", "src", F.col("type").alias("relation"), "dst", g.margin_confidence(F.col("margin")).alias("w"))
    edges = edges.unionByName(r.near(e, both_ways=True).select("scene_id", "src", F.col("type").alias("relation"), "dst", g.margin_confidence(F.col("margin")).alias("w")))
    best = edges.join(spots, ["scene_id", "dst"]).groupBy("scene_id", "src", "relation", "anchor").agg(F.max(F.struct(F.round("w", 6).alias("w"), "dst", "ax", "ay")).alias("b"))
    rows = e.crossJoin(F.broadcast(asked)).join(best.withColumnRenamed("src", "uid"), ["scene_id", "uid", "relation", "anchor"], "left").where(F.col("anchor").isNull() | (F.col("intent") == "label") | (F.col("cls") != F.col("anchor")))
    flat = rows.select("scene_id", "uid", "ord", "query", "intent", "relation", F.col("b.w").alias("weight"), (F.col("cls") == F.col("anchor")).alias("same_label"), g.root_sum(F.col("cx") - F.col("b.ax"), F.col("cy") - F.col("b.ay")).alias("xy"))
    return legacy.score(flat, version)


def _scored_sql(version: int) -> str:
    phrases = " ".join(f"WHEN contains(lower(query), '{p}') THEN '{k}'" for p, k in legacy.SPATIAL)
    labels = " ".join(f"WHEN contains(lower(query), '{c}') THEN '{c}'" for c in sorted(CLASSES, key=lambda x: (-len(x), x)))
    bonus = "CASE WHEN relation IN ('LEFT_OF', 'RIGHT_OF') AND w > 0 THEN 0.5e0 * greatest(0e0, 1 - xy / 5) ELSE 0 END" if version == 2 else "0"
    values = ", ".join(f"('{t}')" for t in ASKED)
    return f"""{PRELUDE}, p AS (SELECT a.scene_id, a.uid AS src, b.uid AS dst, {rel._DELTA}, {rel._CDIST} AS d FROM ent a JOIN ent b ON a.scene_id = b.scene_id AND a.ord <> b.ord
), edges AS (
  SELECT scene_id, src, dst, CASE WHEN abs(dx) = top THEN CASE WHEN dx < 0 THEN 'LEFT_OF' ELSE 'RIGHT_OF' END WHEN abs(dy) = top THEN CASE WHEN dy < 0 THEN 'BEHIND' ELSE 'IN_FRONT_OF' END ELSE CASE WHEN dz < 0 THEN 'BELOW' ELSE 'ABOVE' END END AS relation,
    {rel._confidence(f'(top - greatest(0.3e0, {rel._RUNNER})) / 0.3e0')} AS w FROM p WHERE top >= 0.3
  UNION ALL SELECT scene_id, src, dst, 'NEAR', {rel._confidence('1 - d')} FROM p WHERE d < 1
), best AS (SELECT scene_id, src, relation, cls AS anchor, max({{'w': w, 'dst': dst, 'ax': cx, 'ay': cy}}) AS b FROM edges JOIN (SELECT scene_id, uid AS dst, cls, cx, cy FROM ent) USING (scene_id, dst) GROUP BY ALL
), q0 AS (SELECT query, CASE {phrases} END AS relation, CASE {labels} END AS anchor FROM (VALUES {values}) v(query)
), q AS (SELECT *, CASE WHEN relation IS NOT NULL AND anchor IS NOT NULL THEN 'spatial' WHEN anchor IS NOT NULL THEN 'label' ELSE 'other' END AS intent FROM q0
), rows AS (
  SELECT e.scene_id, e.uid, e.ord, q.query, q.intent, q.relation, coalesce(b.b.w, 0) AS w, e.cls = q.anchor AS same_label, sqrt((e.cx - b.b.ax) ** 2 + (e.cy - b.b.ay) ** 2) AS xy
  FROM ent e CROSS JOIN q LEFT JOIN best b ON b.scene_id = e.scene_id AND b.src = e.uid AND b.relation = q.relation AND b.anchor = q.anchor WHERE q.anchor IS NULL OR q.intent = 'label' OR e.cls <> q.anchor
), scored AS (SELECT scene_id, uid, ord, query, intent, round(CASE WHEN intent = 'spatial' THEN CASE WHEN relation IN ('BELOW', 'ABOVE') THEN coalesce(w * least(greatest(1 - 0.38e0 * xy, 0.05e0), 1e0), 0) ELSE w + {bonus} END WHEN same_label THEN 0.75e0 ELSE 0 END, 3) AS score FROM rows)"""


_TOP = "SELECT scene_id, query, uid, score, row_number() OVER (PARTITION BY scene_id, query ORDER BY score DESC, ord) AS rank FROM scored WHERE score >= 0.2 QUALIFY rank <= CASE intent WHEN 'spatial' THEN 10 WHEN 'label' THEN 6 ELSE 4 END"


@_query(f"WITH {_scored_sql(1)} {_TOP}")
def legacy_topk_v1(spark: SparkSession, sf: str) -> DataFrame:
    return legacy.top_k(scored(spark, sf, 1), ["scene_id", "query"]).select("scene_id", "query", "uid", "score", F.col("rank").cast("long").alias("rank"))


@_query(f"WITH {_scored_sql(2)} {_TOP}")
def legacy_topk_v2(spark: SparkSession, sf: str) -> DataFrame:
    return legacy.top_k(scored(spark, sf, 2), ["scene_id", "query"]).select("scene_id", "query", "uid", "score", F.col("rank").cast("long").alias("rank"))


#: Meshes from line items: each supplier's items are vertices on a grid 20 wide; a square of four is two faces.
MESH = """vert AS (SELECT l_suppkey AS mesh, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1)::BIGINT AS vid, round(l_quantity / 50, 4) AS z FROM lineitem
), v AS (SELECT mesh, vid, (vid % 20)::DOUBLE AS x, (vid // 20)::DOUBLE AS y, z FROM vert
), quad AS (SELECT a.mesh, a.vid FROM v a JOIN v b ON b.mesh = a.mesh AND b.vid = a.vid + 21 WHERE a.vid % 20 < 19
), face AS (SELECT mesh, 2 * vid AS fid, vid AS a, vid + 1 AS b, vid + 20 AS c, vid // 60 AS oid FROM quad UNION ALL SELECT mesh, 2 * vid + 1, vid + 1, vid + 21, vid + 20, vid // 60 FROM quad)"""


def mesh_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    vid = F.col("vid")
    vert = lines.select(F.col("l_suppkey").alias("mesh"), (F.row_number().over(order) - 1).cast("long").alias("vid"), F.round(F.col("l_quantity") / 50, 4).alias("z"))
    vertices = vert.select("mesh", "vid", (vid % 20).cast("double").alias("x"), F.floor(vid / 20).cast("double").alias("y"), "z")
    far = vertices.select("mesh", (vid - 21).alias("vid"))
    quad = vertices.where(vid % 20 < 19).select("mesh", "vid").join(far, ["mesh", "vid"])
    face = lambda n, a, b, c: F.struct((2 * vid + n).alias("fid"), (vid + a).alias("a"), (vid + b).alias("b"), (vid + c).alias("c"))
    faces = quad.select("mesh", F.floor(vid / 60).cast("long").alias("oid"), F.explode(F.array(face(0, 0, 1, 20), face(1, 1, 21, 20))).alias("f")).select("mesh", "oid", "f.*")
    return faces, vertices


@_query(f"""WITH {MESH}, f AS (SELECT face.mesh, fid, p.x AS ax, p.y AS ay, p.z AS az, q.x - p.x AS ux, q.y - p.y AS uy, q.z - p.z AS uz, r.x - p.x AS vx, r.y - p.y AS vy, r.z - p.z AS vz, q.z AS bz, r.z AS cz0 FROM face JOIN v p ON p.mesh = face.mesh AND p.vid = a JOIN v q ON q.mesh = face.mesh AND q.vid = b JOIN v r ON r.mesh = face.mesh AND r.vid = c),
n AS (SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM f) SELECT mesh, fid, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 5) AS nz, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 5) AS area, round((az + bz + cz0) / 3, 5) AS cz FROM n""")
def face_normals(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.face_geometry(*mesh_tables(spark, sf)).select("mesh", "fid", *[F.round(k, 5).alias(k) for k in ("nz", "area", "cz")])


@_query(f"WITH {MESH}, e AS (SELECT mesh, fid, least(p, q) AS lo, greatest(p, q) AS hi FROM (SELECT mesh, fid, unnest([a, b, a]) AS p, unnest([b, c, c]) AS q FROM face)) SELECT mesh, min(fid) AS f, max(fid) AS g FROM e GROUP BY mesh, lo, hi HAVING count(*) = 2")
def face_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.face_adjacency(mesh_tables(spark, sf)[0])


@_query(f"WITH {MESH}, t AS (SELECT mesh, oid, unnest([a, b, c]) AS vid FROM face) SELECT mesh, oid, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM t JOIN v USING (mesh, vid) GROUP BY ALL")
def entity_aabb_from_vertices(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.object_boxes(*mesh_tables(spark, sf))


@_query(f"WITH {PRELUDE} SELECT scene_id, round(degrees(atan2(sum((x1 - x0) * sin(4 * atan2(y1 - y0, x1 - x0))), sum((x1 - x0) * cos(4 * atan2(y1 - y0, x1 - x0))))) / 4, 5) AS yaw FROM ent GROUP BY 1")
def dominant_yaw(spark: SparkSession, sf: str) -> DataFrame:
    e = entities(spark, sf)
    angle = F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    return e.groupBy("scene_id").agg(F.round(g.dominant_yaw(angle, F.col("x1") - F.col("x0")), 5).alias("yaw"))


@_query(f"""WITH {PRELUDE}, p AS (SELECT scene_id, uid, cx, cz - 2 AS y, cy + 6 AS depth FROM ent), q AS (SELECT scene_id, uid, floor(20e0 * cx / depth + 16)::BIGINT AS u, floor(20e0 * y / depth + 12)::BIGINT AS v, depth FROM p WHERE depth > 1e-6),
i AS (SELECT * FROM q WHERE u >= 0 AND u < 32 AND v >= 0 AND v < 24), n AS (SELECT scene_id, u, v, min(depth) AS nearest FROM i GROUP BY ALL) SELECT scene_id, uid, u, v, round(depth, 6) AS depth FROM i JOIN n USING (scene_id, u, v) WHERE depth <= nearest + 0.05e0""")
def visible_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entity centres that a camera at the room's south side sees, by z-buffer."""
    points = entities(spark, sf).select("scene_id", "uid", F.col("cx").alias("x"), (F.col("cz") - 2).alias("y"), (F.col("cy") + 6).alias("z"))
    seen = mesh.visible(mesh.pixels(points, 32, 24, 20.0), ["scene_id"])
    return seen.select("scene_id", "uid", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.round("z", 6).alias("depth"))
