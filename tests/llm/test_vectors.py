"""Product codes and centroid clusters: exact search against all distances, rounds against plain Python, odd input."""

import hashlib
import math
import random

import numpy as np
import pytest

from chainrollup.llm import clustering, vector_codes
from chainrollup.llm.vectors import floor_root

VEC = "vec_id long, embedding array<float>, label int"


def brute(x, entries):
    """Nearest entry, ties to the lower, and the squared distance, in Python's own integers."""
    out = []
    for row in x.tolist():
        d = [sum((a - b) ** 2 for a, b in zip(row, e)) for e in entries.tolist()]
        out.append((d.index(min(d)), min(d)))
    return [tuple(c) for c in zip(*out)] or [(), ()]


@pytest.mark.parametrize("n,width,spread", [(1, 1, 3), (2, 3, 2), (40, 4, 2), (64, 5, 1000), (65, 16, 300), (256, 2, 9), (300, 8, 1 << 26)])
def test_searches_are_exact(n, width, spread):
    rng = np.random.default_rng(n)
    entries, x = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-2 * spread, 2 * spread + 1, (200, width))
    x[:50] = entries[rng.integers(0, n, 50)]  # distance 0
    want = brute(x, entries)
    for index, square in (vector_codes.Slices(entries).nearest(x), clustering.MeanOrder(entries).nearest(x)):
        assert (tuple(index), tuple(square)) == tuple(want)
    assert clustering.MeanOrder(entries).nearest(x[:0])[0].tolist() == []


def test_box_holds_just_the_entries_within_the_radius():
    rng = np.random.default_rng(3)
    entries, x, radius = rng.integers(-9, 10, (100, 3)), rng.integers(-9, 10, (50, 3)), rng.integers(0, 8, 50)
    row, entry = vector_codes.Slices(entries).boxed(x, radius)
    inside = np.abs(x[:, None] - entries[None]).max(2) <= radius[:, None]
    assert (list(row), list(entry)) == tuple(map(list, np.nonzero(inside)))


def test_floor_root():
    a = [k * k + d for k in (1, 2, 1000, 10**6, 2**31) for d in (-1, 0, 1)] + [0]
    assert floor_root(np.array(a, np.int64)).tolist() == [math.isqrt(v) for v in a]
    assert floor_root(np.array([2**80 + 5], object)).tolist() == [2**40]


def sample(spark, rng, n, width):
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(width)], rng.choice([1, 2, None])) for i in rng.sample(range(3 * n), n)]
    rows += [(rows[0][0], rows[1][1], 1), rows[2], rows[2], (None, rows[3][1], None)]  # an id with another vector, a repeated row, no id
    return rows


def plain_kmeans(vectors, start, rounds):
    c = [list(s) for s in start]
    for k in range(rounds + 1):
        near = brute(np.array(vectors), np.array(c))[0]
        if k < rounds:
            for j in range(len(c)):
                own = [v for v, a in zip(vectors, near) if a == j]
                c[j] = [sum(col) // len(own) for col in zip(*own)] if own else c[j]
    return list(zip(*brute(np.array(vectors), np.array(c)))), c


ODD = [(9001, None, 1), (9002, [], 1), (9003, [0.1, float("nan")] * 4, 1), (9004, [0.1, None] * 4, 2), (9005, [float("inf")] * 8, None), (9006, [0.1] * 7, 1), (9007, [1e30] * 8, 1)]


def floats(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def test_product_codes_against_plain_rounds(spark):
    rows = sample(spark, random.Random(5), 120, 8)
    table = spark.createDataFrame([(*r, 1) for r in rows + ODD], VEC + ", code int").repartition(5)
    got, books = vector_codes.product_codes(table, parts=4, entries=16, rounds=3)
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, floats(r[1], 1024)))[:16]
    codes, errors, entries = [], [0] * len(rows), []
    for p in range(4):
        cut = lambda r, p=p: floats(r[1], 1024)[2 * p : 2 * p + 2]
        near, book = plain_kmeans([cut(r) for r in rows], [cut(r) for r in first], 3)
        codes.append([a for a, _ in near])
        errors = [e + d for e, (_, d) in zip(errors, near)]
        entries += book
    assert books.reshape(-1, 2).tolist() == entries
    by_label = {}
    for r, e in zip(rows, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    want = [(r[0], list(c), e, by_label[r[2]]) for r, c, e in zip(rows, zip(*codes), errors)]
    assert sorted(map(tuple, got.select("vec_id", "code", "error", "label_error").collect()), key=str) == sorted(want, key=str)


def test_clusters_against_plain_rounds(spark):
    rows = sample(spark, random.Random(6), 90, 8)
    table = spark.createDataFrame([(*r, "x", 7) for r in rows + ODD], VEC + ", cluster string, v int").repartition(4)
    got = clustering.centroid_clusters(table, clusters=12, rounds=3, width=8)
    digest = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), floats(r[1], 256))
    vectors = [floats(r[1], 256) for r in rows]
    near, c = plain_kmeans(vectors, [floats(r[1], 256) for r in sorted(rows, key=digest)[:12]], 3)
    total, own = sum(d for _, d in near), {}
    for a, d in near:
        own[a] = own.get(a, 0) + d
    want = [(r[0], a, d, own[a], total, c[a]) for r, (a, d) in zip(rows, near)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_few_vectors_and_none(spark):
    none = spark.createDataFrame(ODD[:5], VEC)
    for table in (none, none.limit(0)):
        codes, books = vector_codes.product_codes(table)
        assert codes.collect() == [] and books.size == 0 and clustering.centroid_clusters(table).collect() == []
    three = spark.createDataFrame([(i, [i / 8] * 64, None) for i in (3, 1, 2)], VEC)
    codes, books = vector_codes.product_codes(three)
    assert books.shape == (4, 3, 16) and sorted((r.vec_id, r.code, r.error, r.label_error) for r in codes.collect()) == [(1, [0] * 4, 0, 0), (2, [1] * 4, 0, 0), (3, [2] * 4, 0, 0)]
    got = clustering.centroid_clusters(three).collect()
    assert len({r.cluster for r in got}) == 3 and {r.distance for r in got} == {0}


def test_numbers_beyond_64_bits_within_the_search(spark):
    values = [5e4, -5e4, 4e4, 5e4]
    large = spark.createDataFrame([(i, [v] * 64) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    order = sorted(range(4), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:2]
    vectors = [[int(256 * v)] * 64 for v in values]
    near, _ = plain_kmeans(vectors, [vectors[i] for i in order], 5)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in clustering.centroid_clusters(large, clusters=2).collect()) == [(i, *n) for i, n in enumerate(near)]
