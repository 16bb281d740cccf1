"""Exact k-means in integers with PCA-rotated filtering.

Vectors are rotated once onto the principal axes of all vectors. Stored with each are its leading
coordinates and the norm of the rest. For vector x and centroid c, the squared distance of the leading
coordinates plus the squared difference of the two rests is never above the true squared distance, so
only centroids whose bound does not exceed the best exact distance are verified, in integers.

A round is one pass over the stored table; per task and cluster it sends counts and sums. The driver
holds the centroids and the covariance only, both of a size set by parameters."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reportlake.llm.work import lean, stored

DIMS = 64
LEADING = 16
#: Components beyond this cannot be compared: squared distances would leave 64 bits.
LARGEST = 1 << 27
#: Share of the squared norms that floating-point bounds may be off; true errors are below 1e-13.
SLACK = 1e-10


def whole_vectors(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a vector of `dims` finite components, and their components in integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    right = np.asarray(column.value_lengths().fill_null(-1)) == dims
    rows = np.flatnonzero(right & np.asarray(column.is_valid()))
    flat = column.take(pa.array(rows)).flatten()
    values = np.asarray(flat.fill_null(np.nan)).reshape(len(rows), dims)
    with np.errstate(invalid="ignore", over="ignore"):
        values = np.floor(scale * values)
    fine = (np.abs(values) <= LARGEST).all(axis=1)  # false for NaN
    return rows[fine], values[fine].astype(np.int64)


def _kept(dims: int, scale: int):
    def run(stream):
        for batch in stream:
            rows, values = whole_vectors(batch.column("v"), dims, scale)
            cells = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(dims * 4), len(rows), [None, pa.py_buffer(np.ascontiguousarray(values, "<i4"))])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), cells.cast(pa.binary())], ["id", "v"])

    return run


def unpacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), width)


def _moments(dims: int):
    """One row per task: count, sums, and sums of products."""

    def run(stream):
        total = np.zeros(1 + dims + dims * dims)
        for batch in stream:
            if batch.num_rows:
                x = unpacked(batch.column("v"), "<i4", dims).astype(np.float64)
                total += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["m"])

    return run


def principal_axes(kept: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of all vectors and their principal axes, the widest first. Any orthogonal axes give right
    results; these only make the filter sharp."""
    parts = kept.mapInArrow(lean(_moments(dims)), "m array<double>").select(F.posexplode("m").alias("at", "value"))
    sums = parts.groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros(1 + dims + dims * dims)
    total[sums["at"].to_numpy()] = sums["value"].to_numpy()
    n = max(total[0], 1.0)
    mean = total[1:1 + dims] / n
    _, axes = np.linalg.eigh(total[1 + dims:].reshape(dims, dims) / n - np.outer(mean, mean))
    return mean, np.ascontiguousarray(axes[:, ::-1])


def rotate(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates, and the norm of all others."""
    y = (x - mean) @ axes
    return y[:, :leading], np.sqrt((y[:, leading:] ** 2).sum(1))


def _rotated(mean: np.ndarray, axes: np.ndarray, leading: int, dims: int):
    def run(stream):
        for batch in stream:
            x = unpacked(batch.column("v"), "<i4", dims).astype(np.float64)
            lead, rest = rotate(x, mean, axes, leading)
            packed = np.ascontiguousarray(np.column_stack([lead, rest]), "<f8")
            yield batch.append_column("r", pa.array([row.tobytes() for row in packed], pa.binary()))

    return run


def bounds(lead, rest, center_lead, center_rest, mean) -> np.ndarray:
    """Lower bounds of the squared distances, (vectors, centroids)."""
    a, b = (lead ** 2).sum(1)[:, None], (center_lead ** 2).sum(1)
    out = a + b - 2 * lead @ center_lead.T + (rest[:, None] - center_rest) ** 2
    return out - SLACK * (a + b + rest[:, None] ** 2 + center_rest ** 2 + (mean ** 2).sum())


def nearest(x: np.ndarray, lead, rest, centers: np.ndarray, center_lead, center_rest, mean):
    """Nearest centroid (of equal ones the smallest number), its exact squared distance, and how many
    exact distances were computed."""
    low = bounds(lead, rest, center_lead, center_rest, mean)
    best = low.argmin(1)
    distance = ((x - centers[best]) ** 2).sum(1)
    first, verified = best.copy(), len(x)
    for j in range(len(centers)):
        rows = np.flatnonzero((low[:, j] <= distance) & (first != j))
        verified += len(rows)
        d = ((x[rows] - centers[j]) ** 2).sum(1)
        wins = (d < distance[rows]) | ((d == distance[rows]) & (j < best[rows]))
        best[rows[wins]], distance[rows[wins]] = j, d[wins]
    return best, distance, verified


def _assign(centers, mean, axes, leading, dims):
    """Function of a batch: nearest centroid, distance, vectors."""
    center_lead, center_rest = rotate(centers.astype(np.float64), mean, axes, leading)

    def of(batch):
        x = unpacked(batch.column("v"), "<i4", dims).astype(np.int64)
        r = unpacked(batch.column("r"), "<f8", leading + 1)
        best, distance, _ = nearest(x, r[:, :leading], r[:, leading], centers, center_lead, center_rest, mean)
        return best, distance, x

    return of


def _sums(centers, mean, axes, leading, dims):
    """One row per task and cluster: count, distance in two halves, sums of components."""

    def run(stream):
        assign = _assign(centers, mean, axes, leading, dims)
        total = np.zeros((len(centers), 3 + dims), np.int64)
        for batch in stream:
            if not batch.num_rows:
                continue
            best, distance, x = assign(batch)
            for j in range(len(centers)):
                mine = best == j
                total[j, 0] += mine.sum()
                total[j, 1] += (distance[mine] >> 32).sum()
                total[j, 2] += (distance[mine] & 0xFFFFFFFF).sum()
                total[j, 3:] += x[mine].sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(centers)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "s"])

    return run


def cluster_sums(points: DataFrame, centers, mean, axes, leading: int, dims: int) -> list[list[int]]:
    """Per cluster: count, sum of squared distances, sums of components; exact."""
    parts = points.mapInArrow(lean(_sums(centers, mean, axes, leading, dims)), "cluster int, s array<bigint>")
    rows = (
        parts.select("cluster", F.posexplode("s").alias("at", "value"))
        .groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    )
    total = [[0] * (3 + dims) for _ in range(len(centers))]
    for r in rows:
        total[r["cluster"]][r["at"]] = int(r["value"])
    return [[t[0], (t[1] << 32) + t[2], *t[3:]] for t in total]


def _labelled(centers, mean, axes, leading, dims, inertia, total, digest):
    def run(stream):
        assign = _assign(centers, mean, axes, leading, dims)
        for batch in stream:
            if batch.num_rows:
                best, distance, _ = assign(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(best, pa.int32()), pa.array(distance, pa.int64()),
                     pa.array([inertia[j] for j in best], pa.int64()), pa.array([total] * len(best), pa.int64()),
                     pa.array([digest[j] for j in best], pa.string())],
                    ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


def points_of(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v): vectors of exactly `dims` finite components as packed integers floor(scale * x). Others are
    left out, and so are vectors with a component beyond 2^27 after scaling, whose distances 64 bits do
    not hold."""
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return source.mapInArrow(lean(_kept(dims, scale)), f"id {dict(source.dtypes)['id']}, v binary")


def first_centers(points: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:id`, in that order; repeated ids follow by value,
    a null id counts as `null`."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    rows = points.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.frombuffer(b"".join(bytes(r["v"]) for r in rows), "<i4").reshape(len(rows), dims).astype(np.int64)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10,
            dims: int = DIMS, scale: int = 1024, seed: int = 3, leading: int = LEADING) -> DataFrame:
    """One row per kept vector (see `points_of`): id, cluster, distance (squared), cluster_inertia, inertia,
    centroid_sha256 (of the components, joined by commas).

    Each round assigns every vector to the nearest centroid (of equal ones the smaller number) and moves
    every centroid that has vectors to their componentwise floor(sum / count). With fewer than k vectors
    there are as many centroids. Repeated rows are separate vectors; an empty table gives no rows; other
    columns are ignored."""
    kept = points_of(vectors, id_col, vector_col, dims, scale)
    mean, axes = principal_axes(kept, dims)
    points = stored(kept.mapInArrow(
        lean(_rotated(mean, axes, leading, dims)), f"id {dict(kept.dtypes)['id']}, v binary, r binary"), "points")
    centers = first_centers(points, k, seed, dims)
    for _ in range(rounds):
        for j, (n, _, *sums) in enumerate(cluster_sums(points, centers, mean, axes, leading, dims)):
            if n:
                centers[j] = [s // n for s in sums]
    inertia = [t[1] for t in cluster_sums(points, centers, mean, axes, leading, dims)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    out = points.select("id", "v", "r").mapInArrow(
        lean(_labelled(centers, mean, axes, leading, dims, inertia, sum(inertia), digest)),
        f"id {dict(kept.dtypes)['id']}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return out.withColumnRenamed("id", id_col)
