"""Triangle meshes: face geometry, adjacency, boxes of labelled faces, pinhole views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def face_geometry(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """``mesh, fid, nx, ny, nz, area, cx, cy, cz``: unit normal (0 if degenerate), area and centre of each face."""
    corner = lambda k: vertices.select("mesh", F.col("vid").alias(k), F.struct("x", "y", "z").alias(f"p{k}"))
    full = faces
    for k in ("a", "b", "c"):
        full = full.join(corner(k), ["mesh", k])
    u = [F.col(f"pb.{t}") - F.col(f"pa.{t}") for t in "xyz"]
    v = [F.col(f"pc.{t}") - F.col(f"pa.{t}") for t in "xyz"]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    unit = [F.when(length > 0, x / length).otherwise(0.0) for x in n]
    centre = [(F.col(f"pa.{t}") + F.col(f"pb.{t}") + F.col(f"pc.{t}")) / 3 for t in "xyz"]
    return full.select("mesh", "fid", *[x.alias(f"n{t}") for x, t in zip(unit, "xyz", strict=True)], (length / 2).alias("area"), *[x.alias(f"c{t}") for x, t in zip(centre, "xyz", strict=True)])


def face_adjacency(faces: DataFrame) -> DataFrame:
    """``mesh, f, g``: faces that share an edge which no third face has."""
    side = lambda p, q: F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"))
    edges = faces.select("mesh", "fid", F.explode(F.array(side("a", "b"), side("b", "c"), side("a", "c"))).alias("edge"))
    return edges.groupBy("mesh", "edge").agg(F.min("fid").alias("f"), F.max("fid").alias("g"), F.count(F.lit(1)).alias("n")).where("n = 2").select("mesh", "f", "g")


def object_boxes(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """``mesh, oid`` and the box of the vertices that each object's faces touch."""
    touched = faces.select("mesh", "oid", F.explode(F.array("a", "b", "c")).alias("vid"))
    ends = [f(k).alias(f"{k}{n}") for n, f in ((0, F.min), (1, F.max)) for k in "xyz"]
    return touched.join(vertices, ["mesh", "vid"]).groupBy("mesh", "oid").agg(*ends)


def pixels(points: DataFrame, width: int, height: int, focal: float) -> DataFrame:
    """Points (x right, y down, z ahead) with ``u, v``, those in front of a pinhole and inside the image."""
    ahead = points.where("z > 1e-6")
    placed = ahead.withColumns({"u": F.floor(focal * F.col("x") / F.col("z") + width / 2), "v": F.floor(focal * F.col("y") / F.col("z") + height / 2)})
    return placed.where((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height))


def visible(points: DataFrame, group: list[str], slack: float = 0.05) -> DataFrame:
    """Projected points within ``slack`` of the nearest depth of their pixel: an aggregate and a join, no sort."""
    nearest = points.groupBy(*group, "u", "v").agg(F.min("z").alias("nearest"))
    return points.join(nearest, [*group, "u", "v"]).where(F.col("z") <= F.col("nearest") + slack)
