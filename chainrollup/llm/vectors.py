"""Vectors as whole numbers, and tables of per-task sums: what the two vector operators share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1 << 27  # squared distances of 64 components up to it fit in a long
SLICE = 2048  # vectors that a task looks at together


def whole_vectors(rows: DataFrame, scale: int, id_col: str, vector_col: str, *others: Column) -> DataFrame:
    """vec_id, v (array of floor(scale * x)), others. Without vectors that are null or hold a null or non-finite component, or
    one whose whole number exceeds LIMIT in size, for which a squared distance need not fit in a long."""
    x = rows[vector_col].cast("array<double>")
    v = F.transform(x, lambda c: F.floor(c * scale))
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LIMIT / scale))
    return rows.where(x.isNotNull() & fit).select(rows[id_col].cast("long").alias("vec_id"), v.alias("v"), *others)


def matrix(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    """A list column whose lists are equally long, as a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def sums_of(vectors: DataFrame, groups: int, width: int, assign: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """assign(matrix) gives (group, row) matrices: which rows of `width` numbers add to which of `groups` groups. Each task adds up
    its own before the shuffle; groups * width numbers come to the driver. Returns (counts, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(groups, np.int64), np.zeros((groups, width), np.int64)
        for batch in slices(batches):
            group, row = assign(matrix(batch))
            np.add.at(total, group, row)
            count += np.bincount(group, minlength=groups)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"g": pa.array(used, pa.int32()), "n": pa.array(count[used], pa.int64()), "s": pa.array(list(total[used]), pa.list_(pa.int64()))})

    parts = vectors.select("v").mapInArrow(run, "g int, n long, s array<long>")
    got = parts.groupBy("g").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(width)]).collect()
    count, total = np.zeros(groups, np.int64), np.zeros((groups, width), np.int64)
    for r in got:
        count[r[0]], total[r[0]] = r[1], r[2:]
    return count, total


def floor_root(a: np.ndarray) -> np.ndarray:
    """floor(sqrt(a)) of whole numbers, exactly; also of Python's own in an object array."""
    if a.dtype == object:
        return np.frompyfunc(math.isqrt, 1, 1)(a)
    r = np.sqrt(a.astype(np.float64)).astype(np.int64)
    r -= r * r > a
    return r + ((r + 1) * (r + 1) <= a)


def roomy(x: np.ndarray, most: int) -> np.ndarray:
    """x as it is, or as Python's whole numbers if some exceed `most` in size, so that what is worked out of them can't overflow."""
    return x.astype(object) if x.size and max(int(x.max()), -int(x.min())) > most else x
