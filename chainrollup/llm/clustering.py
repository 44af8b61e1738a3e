"""Centroid clustering of vectors, with nearest centroids found in the order of their means and deviations.

Centroids are sorted by the mean of their components. The search for a vector starts at its own mean and goes outward on both
sides. With k components, sums S and deviations V = sqrt(k * sum of squares - S * S), k times the squared distance of two vectors is at
least (S - S')**2 + (V - V')**2. So a side ends where (S - S')**2 alone exceeds k times the best squared distance, and a
centroid is passed over where both terms do; V is used rounded down, less one, so that all is done in whole
numbers. The squared distance of what is left is worked out exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import floor_root, matrix, roomy, slices, sums_of, whole_vectors


class MeanOrder:
    """Centroids (one a row) for exact search."""

    def __init__(self, centroids: np.ndarray):
        self.width = centroids.shape[1]
        self.most = int((1 << 60) ** 0.5) // (2 * self.width)  # in size, for which the terms of the inequalities fit in 64 bits
        c = roomy(centroids, self.most)
        self.number = np.argsort(c.sum(1), kind="stable")
        self.centroids = c[self.number]
        self.sums, self.deviations = self._figures(self.centroids)

    def _figures(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = x.sum(1)
        return s, floor_root(self.width * (x * x).sum(1) - s * s)

    def _square(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        gap = x - self.centroids[at]
        return (gap * gap).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the number of the nearest centroid (ties: the smallest) and its squared distance."""
        x = roomy(x, self.most)
        sums, deviations = self._figures(x)
        start, n = np.searchsorted(self.sums, sums), len(self.sums)
        first = np.minimum(start, n - 1)
        best, number = self._square(x, first), self.number[first]
        for side, begin in ((1, start), (-1, start - 1)):
            rows, at = np.arange(len(x)), begin
            while True:
                inside = (at >= 0) & (at < n)
                rows, at = rows[inside], at[inside]
                mean = (sums[rows] - self.sums[at]) ** 2
                goes_on = (mean <= self.width * best[rows]).astype(bool)
                rows, at, mean = rows[goes_on], at[goes_on], mean[goes_on]
                if not len(rows):
                    break
                apart = np.maximum(abs(deviations[rows] - self.deviations[at]) - 1, 0)
                near = np.flatnonzero(mean + apart * apart <= self.width * best[rows])
                r, c = rows[near], at[near]
                square, named = self._square(x[r], c), self.number[c]
                better = ((square < best[r]) | (square == best[r]) & (named < number[r])).astype(bool)
                best[r[better]], number[r[better]] = square[better], named[better]
                at = at + side
        return number, best.astype(np.int64)


def centroid_clusters(rows: DataFrame, clusters: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia (squared distances summed over its
    cluster and over all), centroid (array of its cluster's components).

    A component x counts as floor(scale * x). Centroids start as the vectors with the smallest SHA-256 of `seed:vec_id` (repeated ids:
    the lesser vector; null ids last); with fewer vectors than `clusters` there are fewer of them. Each of `rounds` rounds
    assigns all vectors and moves every centroid that has any to their mean, rounded down. Left out are vectors that are null, have
    not `width` components, hold a null or non-finite one or one over vectors.LIMIT / scale in size. Repeated rows each get a row,
    equal centroids leave all to the smallest. Other columns are not read; no vectors give no rows. The centroids are
    what each task is sent, and one figure a cluster is joined to the rows."""
    spark = rows.sparkSession
    vectors = stored(whole_vectors(rows, scale, id_col, vector_col).where(F.size("v") == width), "vectors")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = vectors.orderBy(rank.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not start:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in start], np.int64)
    for _ in range(rounds):
        order = MeanOrder(centroids)
        count, total = sums_of(vectors, len(centroids), width, lambda x, order=order: (order.nearest(x)[0], x))
        centroids = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)
    final = MeanOrder(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            number, square = final.nearest(matrix(batch))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "cluster": number.astype(np.int32), "distance": square})

    assigned = stored(vectors.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    table = [(k, s, sum(inertia.values()), centroids[k].tolist()) for k, s in sorted(inertia.items())]
    figures = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
