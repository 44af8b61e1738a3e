"""Vector compression by product codes, with nearest entries found by slices and intersections.

A vector is cut into parts, and each part stands for the nearest entry of its part's codebook. For every coordinate the entries of
a codebook are sorted, and each place of that order carries the set of the entries up to it, as bits of uint64 words. The
entries within a radius of a vector in one coordinate are two binary searches and the difference of two such sets; the sets of
all coordinates are ANDed, which leaves the entries in a box around the vector. An initial radius grows until its box holds
an entry; the nearest in the box bounds the distance sought, and the box of that bound holds every entry as near: the exact candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import floor_root, matrix, slices, sums_of, whole_vectors

CANDIDATES = 1 << 15  # of which distances are worked out together


class Slices:
    """A codebook for exact search. entries: a matrix of whole numbers, one row an entry."""

    def __init__(self, entries: np.ndarray):
        self.entries, (n, width) = entries, entries.shape
        order = np.argsort(entries, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(entries.T, order, 1)
        bits = np.zeros((width, n, -(-n // 64)), np.uint64)
        np.put_along_axis(bits, (order // 64)[:, :, None], (np.uint64(1) << (order % 64).astype(np.uint64))[:, :, None], 2)
        self.upto = np.concatenate([np.zeros_like(bits[:, :1]), np.bitwise_or.accumulate(bits, axis=1)], axis=1)
        near = [np.partition(np.abs(entries - e).max(1), min(1, n - 1))[min(1, n - 1)] for e in entries]
        self.radius = max(1, int(np.median(near)))  # about one entry or two stand in a box of it

    def boxed(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) of all entries within `radius` of a row of x in every coordinate, in order."""
        mask = np.full((len(x), self.upto.shape[2]), ~np.uint64(0))
        for d in range(x.shape[1]):
            low, high = np.searchsorted(self.sorted[d], x[:, d] - radius, "left"), np.searchsorted(self.sorted[d], x[:, d] + radius, "right")
            mask &= self.upto[d, high] ^ self.upto[d, low]
        return np.nonzero(np.unpackbits(mask.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : len(self.entries)])

    def _best(self, x: np.ndarray, row: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the candidates: the rows that have one, each one's nearest entry (ties: the lowest) and its squared distance."""
        square = np.empty(len(row), np.int64)
        for at in range(0, len(row), CANDIDATES):
            gap = self.entries[entry[at : at + CANDIDATES]] - x[row[at : at + CANDIDATES]]
            square[at : at + CANDIDATES] = np.einsum("ij,ij->i", gap, gap)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(square, first) if len(first) else square
        hit = np.flatnonzero(square == np.repeat(least, np.diff(first, append=len(row))))
        at = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
        return row[first], entry[at], least

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the nearest entry (ties: the lowest) and its squared distance."""
        index, square = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        open_, radius = np.arange(len(x)), self.radius
        while len(open_):
            row, entry, least = self._best(x[open_], *self.boxed(x[open_], np.full(len(open_), radius)))
            index[open_[row]], square[open_[row]] = entry, least
            again = row[least > radius * radius]  # a nearer entry may stand outside of the box
            if len(again):
                part = open_[again]
                row2, entry, least = self._best(x[part], *self.boxed(x[part], floor_root(square[part])))
                index[part[row2]], square[part[row2]] = entry, least
            open_, radius = np.delete(open_, row), 2 * radius
        return index, square


class Codes(NamedTuple):
    """rows: vec_id, code (array of int, an entry for each part), error, label_error. codebooks: part, entry, position; empty without vectors."""

    rows: DataFrame
    codebooks: np.ndarray


def product_codes(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Codes:
    """Codes of all vectors, by codebooks that are learned in `rounds` rounds over all vectors.

    A component x counts as floor(scale * x). Codebooks start as the parts of the vectors with the smallest ids (repeated ids: the
    lesser vector; null ids last); with fewer vectors than `entries` there are fewer entries. Left out are vectors that are null,
    hold a null or non-finite component or one over vectors.LIMIT / scale in size, and those that have not the most
    frequent length among the multiples of `parts` (ties: the shorter). Repeated rows each get a row; null labels are one label.
    Other columns are not read; no vectors give no rows. Codebooks (parts * entries rows) are what each task is sent."""
    whole = whole_vectors(rows, scale, id_col, vector_col, rows[label_col].alias("label"))
    lengths = whole.where((F.size("v") > 0) & (F.size("v") % parts == 0)).groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), "k").limit(1).collect()
    schema = "vec_id long, code array<int>, error long, label_error long"
    if not lengths:
        return Codes(rows.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64))
    width = lengths[0]["k"] // parts
    vectors = stored(whole.where(F.size("v") == lengths[0]["k"]), "vectors")
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    n = books.shape[1]

    for _ in range(rounds):
        slices_of = [Slices(b) for b in books]

        def assign(x: np.ndarray, found: list[Slices] = slices_of) -> tuple[np.ndarray, np.ndarray]:
            own = [x[:, p * width : (p + 1) * width] for p in range(parts)]
            return np.concatenate([p * n + found[p].nearest(own[p])[0] for p in range(parts)]), np.concatenate(own)

        count, total = sums_of(vectors, parts * n, width, assign)
        new = total // np.maximum(count, 1)[:, None]
        books = np.where(count[:, None] > 0, new, books.reshape(-1, width)).reshape(parts, n, width)

    final = [Slices(b) for b in books]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = matrix(batch)
            got = [final[p].nearest(x[:, p * width : (p + 1) * width]) for p in range(parts)]
            code = np.stack([g[0] for g in got], 1).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": pa.FixedSizeListArray.from_arrays(code.reshape(-1), parts).cast(pa.list_(pa.int32())), "error": sum(g[1] for g in got)})

    label = dict(vectors.dtypes)["label"]
    coded = stored(vectors.mapInArrow(encode, f"vec_id long, label {label}, code array<int>, error long"), "codes")
    by_label = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))  # a large label's rows can be split: one row stands on the other side
    return Codes(joined.select("vec_id", "code", "error", "label_error"), books)


def hex_code(code: Column, parts: int = 4) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(code[p])), 2, "0") for p in range(parts)])
