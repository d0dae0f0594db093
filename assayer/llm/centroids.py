"""Centroid clustering in whole numbers; a vantage-point tree finds the nearest centroid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import materialize

#: Components are whole multiples of one part in so many.
SCALE = 1024
#: Centroids that a leaf of the tree holds, at most.
LEAF = 4
#: Squared distances of vectors with no larger component fit 64 bits; beyond, Python's own integers are used.
SMALL = 1 << 27
#: Vectors times tree nodes that one step works on, at most.
STEP = 1 << 21


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors (rows) to one centre."""
    return np.square(x - centre).sum(1)


class VantageTree:
    """Centroids by distance from vantage points, numbered as given.

    A node has one centroid as vantage point; the others are halved by their distance from it, and for each half the
    least and the greatest of these distances are kept. A leaf lists its centroids.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        # per node: vantage point or -1, leaf's centroids, children as (node, least, greatest distance)
        self.points: list[int] = []
        self.leaves: list[list[int]] = []
        self.children: list[list[tuple[int, float, float]]] = []
        todo = [list(range(len(centroids)))]
        while todo:
            # a node's children are numbered in the order in which they were put on the list
            held = todo.pop(0)
            if len(held) <= LEAF:
                self.points.append(-1)
                self.leaves.append(held)
                self.children.append([])
                continue
            point, rest = held[0], np.array(held[1:])
            far = np.sqrt(squared(centroids[rest], centroids[point]).astype(float))
            rest, far = rest[np.argsort(far, kind="stable")], np.sort(far)
            half = len(rest) // 2
            number = len(self.points) + len(todo) + 1
            self.points.append(point)
            self.leaves.append([])
            self.children.append([(number, far[0], far[half - 1]), (number + 1, far[half], far[-1])])
            todo += [rest[:half].tolist(), rest[half:].tolist()]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each vector and its squared distance; of equally near ones the smallest number.

        Best first: each vector takes the waiting node with the least possible distance, until none could hold a
        centroid as near as the best one met. Bounds are rounded down and equal ones are looked into, so ties count.
        """
        parts = [self._nearest(part) for part in np.array_split(x, max(1, -(-len(x) * len(self.points) // STEP)))]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        best = np.full(n, -1, np.int64)
        least = np.zeros(n, x.dtype)
        radius = np.full(n, np.inf)
        waiting = np.full((n, len(self.points)), np.inf)
        waiting[:, 0] = 0
        live = np.arange(n)
        while len(live):
            node = waiting[live].argmin(1)
            going = (bound := waiting[live, node]) <= radius[live]
            going &= np.isfinite(bound)
            live, node = live[going], node[going]
            waiting[live, node] = np.inf
            for m in np.unique(node).tolist():
                at = live[node == m]
                if self.points[m] < 0:
                    for c in self.leaves[m]:
                        self._meet(x, at, c, best, least, radius)
                    continue
                far = np.sqrt(self._meet(x, at, self.points[m], best, least, radius).astype(float))
                for child, low, high in self.children[m]:
                    # a part in a billion covers what roots and differences lose in rounding
                    waiting[at, child] = np.maximum(np.maximum(low - far, far - high) - 1e-9 * (far + high), 0)
        return best, least

    def _meet(self, x, at, c, best, least, radius) -> np.ndarray:
        d = squared(x[at], self.centroids[c])
        nearer = (best[at] < 0) | (d < least[at]) | (d == least[at]) & (c < best[at])
        won = at[nearer]
        best[won], least[won] = c, d[nearer]
        radius[won] = np.sqrt(d[nearer].astype(float)) * (1 + 1e-9)
        return d


def _matrix(column: pa.Array, dims: int, reach: int) -> np.ndarray:
    """Rows of whole numbers, as Python's integers where squares might not fit."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
    small = reach <= SMALL and (not x.size or max(int(x.max()), -int(x.min())) <= SMALL)
    return x if small else x.astype(object)


class _Assigner:
    """What each round sends to the tasks: the centroids; a task builds its tree from them."""

    def __init__(self, centroids: list[list[int]], dims: int):
        self.centroids, self.dims = centroids, dims
        self.reach = max((abs(v) for c in centroids for v in c), default=0)

    def assigned(self, batches: Iterator[pa.RecordBatch]):
        kind = np.int64 if self.reach <= SMALL else object
        tree = VantageTree(np.array(self.centroids, kind).reshape(-1, self.dims))
        wide = None
        for batch in batches:
            x = _matrix(batch.column("x"), self.dims, self.reach)
            if not len(x):
                continue
            if x.dtype == object and tree.centroids.dtype != object:
                wide = wide or VantageTree(np.array(self.centroids, object).reshape(-1, self.dims))
                yield batch, x, *wide.nearest(x)
            else:
                yield batch, x, *tree.nearest(x)

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task and centroid: its vectors' number and component sums."""
        k = len(self.centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, self.dims), object)
        for _, x, cluster, _ in self.assigned(batches):
            counts += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster).tolist():
                sums[c] += x[cluster == c].sum(0).astype(object)
        rows = [(c, int(counts[c]), d, str(sums[c, d])) for c in np.flatnonzero(counts).tolist() for d in range(self.dims)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["cluster", "n", "dim", "total"])

    def nearest(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, d in self.assigned(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array([str(v) for v in d.tolist()])],
                names=["vec_id", "cluster", "distance"],
            )


def whole_numbers(vectors: DataFrame, dims: int) -> DataFrame:
    """``(vec_id, x)`` of the vectors that are kept: ``dims`` components, none null or non-finite, in whole numbers."""
    value = F.col("embedding").cast("array<double>")
    # the largest and smallest doubles whose multiples a long holds
    far = float(1 << 52)
    fits = lambda v: v.isNotNull() & ~F.isnan(v) & v.between(-far, far)
    return vectors.where((F.size(value) == dims) & F.forall(value, fits)).select(
        F.col("vec_id").cast("long"), F.transform(value, lambda v: F.floor(F.lit(float(SCALE)) * v)).alias("x")
    )


def _seed_order(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)


def clusters(vectors: DataFrame, k: int = 8, dims: int = 64, rounds: int = 10, seed: int = 3) -> DataFrame:
    """Clusters of ``vectors(vec_id, embedding)``, one row per vector that is kept; other columns are left out.

    Kept are vectors of ``dims`` components, none null, non-finite or beyond 2^52. Centroids start as the ``k`` vectors
    whose id has the smallest hash (equal ids: smaller vector first; null ids last), fewer if there are fewer. Each
    round assigns all vectors to the nearest centroid, ties to the smaller number, and moves every centroid that has
    vectors to their mean, rounded down; then all are assigned once more. All numbers are exact; a distance or inertia
    that no long holds is null. Repeated rows count each, an empty table gives no rows.

    Only ``k`` centroids go to the tasks and only their sums, added up per task and by Spark, come back.
    """
    spark = vectors.sparkSession
    kept = materialize(whole_numbers(vectors, dims), "whole")
    first = kept.orderBy(_seed_order(seed).asc_nulls_last(), "x").limit(k).select("x").collect()
    centroids = [list(r["x"]) for r in first]
    for _ in range(rounds if centroids else 0):
        at = _Assigner(centroids, dims)
        partial = kept.select("vec_id", "x").mapInArrow(at.sums, "cluster long, n long, dim long, total string")
        whole = F.col("total").cast("decimal(38,0)")
        added = partial.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(whole).cast("string").alias("total"))
        for r in added.collect():
            centroids[r["cluster"]][r["dim"]] = int(r["total"]) // r["n"]
    at = _Assigner(centroids, dims)
    assigned = kept.mapInArrow(at.nearest, "vec_id long, cluster int, distance string") if centroids else None
    if assigned is None:
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    assigned = materialize(assigned.withColumn("distance", F.col("distance").cast("decimal(38,0)")), "assigned")
    # one row per centroid
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = inertia.select("*", F.sum("cluster_inertia").over(Window.partitionBy()).alias("inertia"))
    named = spark.createDataFrame([(c, ",".join(map(str, x))) for c, x in enumerate(centroids)], "cluster int, listed string")
    about = inertia.join(named, "cluster").withColumn("centroid_sha256", F.sha2("listed", 256)).drop("listed")
    fitted = lambda name: F.expr(f"try_cast({name} AS BIGINT)").alias(name)
    return assigned.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", fitted("distance"), fitted("cluster_inertia"), fitted("inertia"), "centroid_sha256"
    )

