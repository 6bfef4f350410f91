"""Exact clustering of integer vectors around centroids.

Vectors are kept in blocks. A task expands |x|^2 - 2 x.c + |c|^2 by one matrix product in float64 for each block, which
is exact as long as no sum can reach 2^53; blocks or centroids beyond that bound are computed in Python's integers.
Sums and counts of the clusters are combined by the RDD's treeAggregate, so the driver gets one small table a round.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Workspace

#: Vectors in a block.
BLOCK = 1024
#: Below this every integer has its own float64.
EXACT = 1 << 53
_LONG = (1 << 63) - 1


def usable(vectors: DataFrame, column: str, dims: int) -> DataFrame:
    """Rows whose vector has exactly `dims` components, none null, NaN or infinite."""
    x = F.col(column).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col(column).isNotNull() & (F.size(column) == dims)).where(sound)


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            part = batch.slice(low, BLOCK)
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
            yield pa.RecordBatch.from_arrays([ids, pa.array([part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()], pa.binary())], ["ids", "xs"])


def quantised(raw: bytes, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a block's components: float64 where that is exact, else Python's integers."""
    x = np.frombuffer(raw, "<f8").reshape(-1, dims)
    with np.errstate(over="ignore"):
        q = np.floor(x * scale)
    if not q.size or np.abs(q).max() < EXACT:
        return q
    return np.array([math.floor(v * scale) if math.isfinite(v * scale) else int(v) * scale for v in x.ravel().tolist()], object).reshape(x.shape)


def _integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else x.astype(np.int64).astype(object)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of two as near) and squared distance of each vector, exact."""
    top = max((abs(v) for c in centroids for v in c), default=0) + (int(np.abs(x).max()) if x.size else 0)
    if x.dtype != object and x.shape[1] * top * top < EXACT:  # bounds every term and partial sum
        c = np.array(centroids, np.float64)
        far = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        near = far.argmin(1)
        return near, far[np.arange(len(x)), near].astype(np.int64)
    x, c = _integers(x), np.array(centroids, object)
    near, least = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    for i, row in enumerate(x):
        far = ((row - c) ** 2).sum(1)
        near[i] = far.argmin()
        least[i] = far[near[i]]
    return near, least


def cluster_sums(x: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums by cluster, exact."""
    member = near == np.arange(k)[:, None]
    if x.dtype != object and (not x.size or len(x) * int(np.abs(x).max()) < EXACT):
        return _integers(member.astype(np.float64) @ x)
    return np.array([_integers(x[m]).sum(0) if m.any() else np.zeros(x.shape[1], object) for m in member], object)


def _gathered(blocks: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> tuple[np.ndarray, list[int], list[int]]:
    """Sums, sizes and distances of the clusters over all blocks."""
    k = len(centroids)

    def add(have: tuple, row) -> tuple:
        x = quantised(bytes(row[0]), dims, scale)
        near, far = nearest(x, centroids)
        sizes = np.bincount(near, minlength=k)
        return (have[0] + cluster_sums(x, near, k), [a + int(b) for a, b in zip(have[1], sizes, strict=True)], [a + sum(int(v) for v in far[near == i]) for i, a in enumerate(have[2])])

    def both(a: tuple, b: tuple) -> tuple:
        return (a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)], [x + y for x, y in zip(a[2], b[2], strict=True)])

    return blocks.select("xs").rdd.treeAggregate((np.zeros((k, dims), object), [0] * k, [0] * k), add, both)


def _assigned(centroids: list[list[int]], own: list[int], dims: int, scale: int) -> Callable:
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    most = [min(v, _LONG) for v in own]
    whole = min(sum(own), _LONG)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(0).slice(r, 1).flatten()
                near, far = nearest(quantised(batch.column(1)[r].as_py(), dims, scale), centroids)
                near_list, n = near.tolist(), len(near)
                yield pa.RecordBatch.from_arrays([ids, pa.array(near_list, pa.int32()), pa.array([min(int(v), _LONG) for v in far], pa.int64()), pa.array([most[c] for c in near_list], pa.int64()), pa.array([whole] * n, pa.int64()), pa.array([shas[c] for c in near_list], pa.string())], ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return assign


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """Rows (id, cluster, distance, cluster_inertia, inertia, centroid_sha256), and the k final centroids.

    Vectors that usable() leaves out have no row. Components become floor(scale * x). The first centroids are the k
    vectors with the least sha256 of "seed:id" (a null id is hashed as an empty text; rows with one id go by their
    components); with fewer than k vectors there are as many centroids. After each of the rounds a centroid that has
    vectors moves to floor(sum / count). Repeated rows count as often as they occur. Distances over 2^63 - 1 are given
    as that number, though they are compared exactly. Without vectors there are neither centroids nor rows.
    """
    space = Workspace(vectors.sparkSession)
    slim = usable(vectors, column, dims).select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("x"))
    kind = slim.schema["id"].dataType.simpleString()
    blocks = space.write(slim.mapInArrow(_to_blocks, f"ids array<{kind}>, xs binary"), "blocks")
    chosen = slim.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), "x").limit(k).collect()
    centroids = [[int(v) for v in quantised(np.array(r["x"], "<f8").tobytes(), dims, scale)[0]] for r in chosen]
    own = [0] * len(centroids)
    if centroids:
        for _ in range(rounds):
            sums, sizes, _ = _gathered(blocks, centroids, dims, scale)
            centroids = [[int(v) // n for v in row] if n else old for row, n, old in zip(sums, sizes, centroids, strict=True)]
        own = _gathered(blocks, centroids, dims, scale)[2]
    out = blocks.mapInArrow(_assigned(centroids, own, dims, scale), f"id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return out.withColumnRenamed("id", id_column), centroids
