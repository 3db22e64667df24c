"""Scenes derived from the ``embeddings`` table, and the same tables as SQL.

Fifty consecutive vectors are a scene of fifty labelled boxes in a room of 8 x 8 x 4
metres; contacts with floor, wall and furniture are planted by id. The SQL text
states the same derivation for a reader, or engine, that prefers SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Class of each label; the first five carry things.
CLASSES = ("table", "desk", "chair", "shelf", "sofa", "cup", "book", "lamp", "picture", "rug")
SUPPORT = CLASSES[:5]
#: Surface, type, plane a b c d, box of its rectangle.
SURFACES = (
    ("floor", "floor", 0.0, 0.0, 1.0, 0.0, -4.0, -4.0, 0.0, 4.0, 4.0, 0.0),
    ("ceiling", "ceiling", 0.0, 0.0, -1.0, 4.0, -4.0, -4.0, 4.0, 4.0, 4.0, 4.0),
    ("wall_w", "wall", 1.0, 0.0, 0.0, 4.0, -4.0, -4.0, 0.0, -4.0, 4.0, 4.0),
    ("wall_e", "wall", -1.0, 0.0, 0.0, 4.0, 4.0, -4.0, 0.0, 4.0, 4.0, 4.0),
    ("wall_s", "wall", 0.0, 1.0, 0.0, 4.0, -4.0, -4.0, 0.0, 4.0, -4.0, 4.0),
    ("wall_n", "wall", 0.0, -1.0, 0.0, 4.0, -4.0, 4.0, 0.0, 4.0, 4.0, 4.0),
)
_SURFACE_COLUMNS = "surface string, surface_type string, a double, b double, c double, d double, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.element_at("embedding", k).cast("double")
    half = lambda k: F.round(0.05 + 2 * F.abs(e(k)), 4)
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("ord"), F.floor(F.col("vec_id") / 50).cast("long").alias("scene_id"), F.col("label"),
        F.element_at(F.array(*map(F.lit, CLASSES)), F.col("label") + 1).alias("cls"),
        half(4).alias("hx"), half(5).alias("hy"), half(6).alias("hz"), e(1).alias("e1"), e(2).alias("e2"), e(3).alias("e3"),
    )
    cx = F.when(F.col("ord") % 7 == 0, -4 + F.col("hx")).otherwise(F.round(10 * F.col("e1"), 4))
    bottom = F.when(F.col("ord") % 4 == 0, 0.0).otherwise(F.round(0.1 + 6 * F.abs("e3"), 4))
    return base.select("ord", "scene_id", "label", "cls", "hx", "hy", "hz", cx.alias("cx"), F.round(10 * F.col("e2"), 4).alias("cy"), bottom.alias("z0"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scene_id, ord, uid, label, cls`` and the box and centroid of every entity."""
    raw = _raw(spark, sf_dir)
    below = raw.where("label < 5 and ord % 5 = 0").select("scene_id", (F.col("ord") + 1).alias("ord"), F.col("cx").alias("px"), F.col("cy").alias("py"), F.round(F.col("z0") + 2 * F.col("hz") + 0.005, 4).alias("pz"))
    both = raw.join(below, ["scene_id", "ord"], "left").select(
        "scene_id", "ord", "label", "cls", "hx", "hy", "hz", F.coalesce("px", "cx").alias("cx"), F.coalesce("py", "cy").alias("cy"), F.coalesce("pz", "z0").alias("z0"))
    return both.select(
        "scene_id", "ord", F.concat(F.lit("obj_"), F.col("ord").cast("string")).alias("uid"), "label", "cls",
        F.round(F.col("cx") - F.col("hx"), 4).alias("x0"), F.round(F.col("cy") - F.col("hy"), 4).alias("y0"), F.round("z0", 4).alias("z0"),
        F.round(F.col("cx") + F.col("hx"), 4).alias("x1"), F.round(F.col("cy") + F.col("hy"), 4).alias("y1"), F.round(F.col("z0") + 2 * F.col("hz"), 4).alias("z1"),
        F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), F.round(F.col("z0") + F.col("hz"), 4).alias("cz"),
    )


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six surfaces of every scene; their literals are broadcast."""
    scenes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / 50).cast("long").alias("scene_id")).distinct()
    fixed = spark.createDataFrame([(*s,) for s in SURFACES], _SURFACE_COLUMNS)
    return scenes.crossJoin(F.broadcast(fixed))


def _sql_rows(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}e0" for v in row) + ")" for row in rows)


PRELUDE = f"""
raw AS (
  SELECT vec_id AS ord, (vec_id // 50)::BIGINT AS scene_id, label, ([{", ".join(f"'{c}'" for c in CLASSES)}])[label + 1] AS cls,
    round(0.05e0 + 2 * abs(embedding[4]::DOUBLE), 4) AS hx, round(0.05e0 + 2 * abs(embedding[5]::DOUBLE), 4) AS hy, round(0.05e0 + 2 * abs(embedding[6]::DOUBLE), 4) AS hz,
    round(10 * embedding[1]::DOUBLE, 4) AS rx, round(10 * embedding[2]::DOUBLE, 4) AS cy, round(0.1e0 + 6 * abs(embedding[3]::DOUBLE), 4) AS rz
  FROM embeddings
), placed AS (
  SELECT ord, scene_id, label, cls, hx, hy, hz, CASE WHEN ord % 7 = 0 THEN -4 + hx ELSE rx END AS cx, cy, CASE WHEN ord % 4 = 0 THEN 0e0 ELSE rz END AS z0 FROM raw
), stacked AS (
  SELECT p.ord, p.scene_id, p.label, p.cls, p.hx, p.hy, p.hz, coalesce(u.cx, p.cx) AS cx, coalesce(u.cy, p.cy) AS cy, coalesce(round(u.z0 + 2 * u.hz + 0.005e0, 4), p.z0) AS z0
  FROM placed p LEFT JOIN placed u ON u.scene_id = p.scene_id AND u.ord + 1 = p.ord AND u.label < 5 AND u.ord % 5 = 0
), ent AS (
  SELECT scene_id, ord, 'obj_' || ord AS uid, label, cls, round(cx - hx, 4) AS x0, round(cy - hy, 4) AS y0, round(z0, 4) AS z0, round(cx + hx, 4) AS x1, round(cy + hy, 4) AS y1,
    round(z0 + 2 * hz, 4) AS z1, round(cx, 4) AS cx, round(cy, 4) AS cy, round(z0 + hz, 4) AS cz FROM stacked
), surf AS (
  SELECT s.scene_id, f.* FROM (SELECT DISTINCT (vec_id // 50)::BIGINT AS scene_id FROM embeddings) s,
    (VALUES {_sql_rows(SURFACES)}) f(surface, surface_type, a, b, c, d, x0, y0, z0, x1, y1, z1)
)"""
