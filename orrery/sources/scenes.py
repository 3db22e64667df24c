"""Sources and sinks: labelled scene files, meshes, content locks, graph tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Classes that are not entities.
DROPPED = ("undefined", "non-plane", "plane")
STRUCTURE = ("floor", "wall", "ceiling")
SCENE = "gravity_dir array<double>, objects array<struct<id:long,class_name:string,oriented_bbox:struct<abb:struct<center:array<double>,sizes:array<double>>,orientation:struct<rotation:array<double>,translation:array<double>>>>>"


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """``scene, oid, cls, structural`` and the tight box of every object of multi-line JSON scene files.

    An oriented box becomes the box around its turned corners, in closed form.
    """
    from orrery.functions.geometry import oriented_half_extent, quaternion_matrix

    raw = spark.read.schema(SCENE).json(path, multiLine=True).select(F.input_file_name().alias("scene"), F.explode("objects").alias("o"))
    kept = raw.where(~F.col("o.class_name").isin(*DROPPED))
    q = [F.get("o.oriented_bbox.orientation.rotation", F.lit(k)) for k in range(4)]
    part = lambda name, k: F.get(f"o.oriented_bbox.{name}", F.lit(k))
    matrix = quaternion_matrix(*q)
    centre = [sum((m * part("abb.center", j) for j, m in enumerate(row)), F.lit(0.0)) + part("orientation.translation", i) for i, row in enumerate(matrix)]
    half = oriented_half_extent(matrix, [part("abb.sizes", k) / 2 for k in range(3)])
    ends = [(c + s * h).alias(f"{k}{n}") for n, s in ((0, -1), (1, 1)) for k, c, h in zip("xyz", centre, half, strict=True)]
    return kept.select("scene", F.col("o.id").alias("oid"), F.col("o.class_name").alias("cls"), F.col("o.class_name").isin(*STRUCTURE).alias("structural"), *ends)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """``mesh, vid, x, y, z``: vertices of ASCII or little-endian binary PLY files, one task per file."""
    widths = {"char": "i1", "uchar": "u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8", "int8": "i1", "uint8": "u1", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8"}

    def vertices(content: bytes) -> np.ndarray:
        head, body = content.split(b"end_header\n", 1)
        lines = [x.split() for x in head.decode().splitlines()]
        count, fields, inside = 0, [], False
        for line in lines:
            if line[:1] == ["element"]:
                inside = line[1] == "vertex"
                count = int(line[2]) if inside else count
            elif line[:1] == ["property"] and inside:
                fields.append((line[2], widths[line[1]]))
        if ["format", "ascii", "1.0"] in lines:
            table = np.array([x.split()[: len(fields)] for x in body.decode().splitlines()[:count]], float).reshape(count, len(fields))
            names = [n for n, _ in fields]
            return np.stack([table[:, names.index(k)] for k in "xyz"], 1)
        table = np.frombuffer(body, np.dtype(fields), count)
        return np.stack([table[k].astype(float) for k in "xyz"], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                points = vertices(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(points)), pa.array(np.arange(len(points))), *(pa.array(points[:, k]) for k in range(3))], names=["mesh", "vid", "x", "y", "z"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "mesh string, vid long, x double, y double, z double")


def locked(spark: SparkSession, path: str, lock: DataFrame) -> DataFrame:
    """``path, reason`` of files that differ from a lock (path, sha256, length) or lack an entry; empty when all agree."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("digest"), F.col("length").alias("size"))
    both = files.join(lock, "path", "full")
    reason = F.when(F.col("digest").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when((F.col("digest") != F.col("sha256")) | (F.col("size") != F.col("length")), "changed")
    return both.select("path", reason.alias("reason")).where("reason is not null")


def write_graph(edges: DataFrame, path: str) -> None:
    """Store an edge table by relation; questions about one relation then read its folder alone."""
    edges.write.mode("overwrite").partitionBy("type").parquet(path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def nearest_in_time(frames: DataFrame, poses: DataFrame, reach: float = 0.002) -> DataFrame:
    """Each frame (``scene, frame, ts``) with the pose (``scene, pose, at``) nearest in time, within ``reach`` seconds.

    Both sides are dealt to slots as wide as ``reach``, poses to three, so the range
    join is an equality; ties go to the earlier pose.
    """
    slot = lambda t, k: (F.floor(F.col(t) / reach) + k).cast("long")
    near = poses.select("*", F.explode(F.array(*[slot("at", k) for k in (-1, 0, 1)])).alias("slot"))
    met = frames.withColumn("slot", slot("ts", 0)).join(near, ["scene", "slot"]).withColumn("gap", F.abs(F.col("ts") - F.col("at"))).where(F.col("gap") <= reach)
    return met.groupBy("scene", "frame", "ts").agg(F.min(F.struct("gap", "at", "pose")).alias("m")).select("scene", "frame", "ts", "m.pose", "m.gap")
