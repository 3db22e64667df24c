"""Centroid clustering on integers, with a distance matrix that is kept up by increments.

Every vector keeps its exact integer products with all centroids. When centroids
move, a product changes by the vector's components times the centroid's changes, so
only the components that did change are multiplied; the nearest centroid follows
from |x|^2 - 2 x.c + |c|^2 and all of it is exact. A round reads the products of the
round before, writes its own, and sums the vectors of each cluster; what reaches
the driver is one row of sums for each centroid. A round in which no
centroid moved ends the work, as later ones would repeat it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import files
from orrery.llm.common import table

CENTROIDS, ROUNDS, SIZE, SCALE = 8, 10, 64, 1024
#: Components beyond this raise: a squared distance of 64 of them would not fit into a long.
LIMIT = 1 << 27
_STATE = "vec_id long, x array<int>, norm long, products array<long>"


def usable(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows whose vector has exactly ``size`` components, none null, NaN or infinite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where((F.size("embedding") == size) & F.forall("embedding", finite))


def seeds(kept: DataFrame, k: int = CENTROIDS, salt: str = "3:", scale: int = SCALE) -> np.ndarray:
    """The ``k`` vectors of the least SHA-256 of salt and id, in that order (ties: by components), as integers.

    A vector without id is clustered but never a seed. With fewer vectors there are fewer centroids.
    """
    hashed = kept.where("vec_id is not null").select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("hash"), "embedding")
    first = hashed.orderBy("hash", "embedding").limit(k).collect()
    return _whole(np.array([r["embedding"] for r in first], np.float64), scale)


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(x * scale)
    if scaled.size and np.abs(scaled).max() > LIMIT:
        raise OverflowError(f"a component times {scale} is beyond {LIMIT}")
    return scaled.astype(np.int64)


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1), kind))


def begun(kept: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``vec_id, x, norm, products``: integer vectors and their products with the first centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _whole(_matrix(batch.column(1), batch.num_rows), scale)
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(x, pa.int32()), pa.array((x * x).sum(1)), _lists(x @ centroids.T, pa.int64())], names=["vec_id", "x", "norm", "products"])

    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, _STATE)


def moved(state: DataFrame, change: np.ndarray) -> DataFrame:
    """``state`` after the centroids changed by ``change``: only components that changed are read and multiplied."""
    parts = [(k, np.flatnonzero(change[k])) for k in range(len(change)) if change[k].any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, products = _matrix(batch.column(1), batch.num_rows), _matrix(batch.column(3), batch.num_rows).copy()
                for k, at in parts:
                    products[:, k] += x[:, at].astype(np.int64) @ change[k, at]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _lists(products, pa.int64())], names=["vec_id", "x", "norm", "products"])

    return state.mapInArrow(run, _STATE)


def _nearest(batch: pa.RecordBatch, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance by the kept norms and products (columns -2 and -1); ties go to the smaller number."""
    squares = batch.column(batch.num_columns - 2).to_numpy()[:, None] - 2 * _matrix(batch.column(batch.num_columns - 1), batch.num_rows) + norms
    cluster = squares.argmin(1)
    return cluster, squares[np.arange(len(squares)), cluster]


def totals(state: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """By cluster: how many vectors, their summed distance, and their sum. Each task sends one row a cluster at most."""
    norms, size = (centroids * centroids).sum(1), centroids.shape[1]
    columns = [f"s{j}" for j in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(norms), size + 2), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, distance = _nearest(batch, norms)
            if float(sums[:, 1].sum()) + distance.sum(dtype=np.float64) > 2.0**62:
                raise OverflowError("the summed distance does not fit into a long")
            x = _matrix(batch.column(0), batch.num_rows).astype(np.int64)
            for k in np.unique(cluster):
                own = cluster == k
                sums[k] += np.concatenate([[own.sum(), distance[own].sum()], x[own].sum(0)])
        full = np.flatnonzero(sums[:, 0])
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full), *(pa.array(sums[full, j]) for j in range(size + 2))], names=["cluster", "n", "inertia", *columns])

    schema = "cluster long, n long, inertia long, " + ", ".join(f"{c} long" for c in columns)
    parts = state.select("x", "norm", "products").mapInArrow(run, schema)
    rows = parts.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in ("n", "inertia", *columns))).collect()
    return {r["cluster"]: (r["n"], r["inertia"], [r[c] for c in columns]) for r in rows}


def cluster_vectors(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, salt: str = "3:") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance, cluster_inertia, inertia`` of every usable vector, and the final centroids.

    Vectors that are null, of another size, or hold a null, NaN or infinite component
    are left out. A null vec_id is clustered and never a seed; repeated rows count as
    often as they occur; equally near centroids: the smaller number; an
    empty cluster keeps its centroid; without any vector, or any vec_id, the result is empty. Components
    beyond LIMIT / scale raise. Other columns of ``rows`` are not read.

    The state of a round is dropped once the next one is written.
    """
    spark = rows.sparkSession
    kept = usable(rows, size)
    centroids = seeds(kept, k, salt, scale)
    result = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], result + ", cluster_inertia long, inertia long"), centroids
    path = files.fresh(spark, "products")
    state = files.write(begun(kept, centroids, scale), path)
    found = totals(state, centroids)
    for _ in range(rounds):
        after = np.array([[s // found[j][0] for s in found[j][2]] if j in found else centroids[j].tolist() for j in range(len(centroids))], np.int64)
        change, centroids = after - centroids, after
        if not change.any():
            break
        old, path = path, files.fresh(spark, "products")
        state = files.write(moved(state, change), path)
        files.drop(spark, old)
        found = totals(state, centroids)
    norms = (centroids * centroids).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = _nearest(batch, norms)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    assigned = state.select("vec_id", "norm", "products").mapInArrow(run, result)
    whole = sum(x[1] for x in found.values())
    sums = spark.createDataFrame([(j, x[1], whole) for j, x in found.items()], "cluster int, cluster_inertia long, inertia long")
    return assigned.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia"), centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    digests = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(r: int) -> str:
    """Assignment of round ``r`` and the centroids after it."""
    return f"""
, near{r} AS MATERIALIZED (
  SELECT rid, k, d FROM (
    SELECT v.rid, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM kept v, c{r} c
  ) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1
), mean{r} AS (
  SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x
  FROM (SELECT k, j, sum(u) AS s, count(*) AS n
        FROM (SELECT a.k, unnest(v.x) AS u, generate_subscripts(v.x, 1) AS j FROM near{r} a JOIN kept v USING (rid))
        GROUP BY k, j)
  GROUP BY k
), c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN mean{r} m USING (k))"""


OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS k, x
  FROM kept WHERE vec_id IS NOT NULL QUALIFY k < {CENTROIDS}
){"".join(map(_round, range(ROUNDS + 1)))}
SELECT v.vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM near{ROUNDS} a JOIN kept v USING (rid) JOIN c{ROUNDS} c ON c.k = a.k
"""
