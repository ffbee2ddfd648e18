import hashlib
import math

import numpy as np
import pytest

from pagelens.llm import clusters as C
from pagelens.llm import vector_codes as V
from pagelens.llm.vectors import as_matrix, grid_limit, on_grid

SCHEMA = "vec_id long, embedding array<double>, label int, Cluster string, v int"


def awkward(dims, n=300, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=dims)).tolist(), i % 4 or None, "x", 1) for i in range(n)]
    rows += [rows[5], rows[5], rows[7]]  # repeated rows
    rows += [(n + i, rows[3][1], 1, None, None) for i in range(60)]  # equal vectors
    rows += [(None, rows[1][1], 2, None, None), (None, [0.0] * dims, 2, None, None)]
    rows += [(900, None, 1, "x", 1), (901, [], 1, "x", 1), (902, [None] + [0.1] * (dims - 1), 1, "x", 1), (903, [0.1] * (dims - 1), 1, "x", 1)]
    rows += [(904 + i, [bad] + [0.1] * (dims - 1), 1, "x", 1) for i, bad in enumerate((math.nan, math.inf, -math.inf, 1e300))]
    rows += [(910, [700_000.25] * dims, 5, "x", 1), (911, [-700_000.25] * dims, 5, "x", 1)]  # far, but within the grid
    return rows


def kept(rows, dims):
    found = []
    for vec_id, x, label, *_ in rows:
        if x is not None and len(x) == dims and all(c is not None and math.isfinite(c) and abs(c) < 1e100 for c in x):
            found.append((vec_id, [math.floor(256 * c) for c in x], label))
    return found


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def first_nearest(x, entries):
    return min(range(len(entries)), key=lambda j: (squared(x, entries[j]), j))


def replaced(entries, members):
    return [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for e, m in zip(entries, members, strict=True)]


def plain_clusters(rows, k, rounds):
    def key(row):
        return (row[0] is None, hashlib.sha256(f"2:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])

    centroids = [v for _, v, _ in sorted(rows, key=key)[:k]]
    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v, _ in rows:
            members[first_nearest(v, centroids)].append(v)
        centroids = replaced(centroids, members)
    found = [(i, first_nearest(v, centroids), v) for i, v, _ in rows]
    distance = [(i, j, squared(v, centroids[j])) for i, j, v in found]
    total = sum(d for *_, d in distance)

    def long(n):
        return n if n < 2**63 else None

    return [
        (i, j, d, long(sum(e for _, m, e in distance if m == j)), long(total), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
        for i, j, d in distance
    ]


def order(rows):
    return sorted(rows, key=str)


def test_clusters_equal_brute_force(spark):
    rows = awkward(64)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    scans = []
    found = C.cluster_vectors(frame, clusters=12, rounds=4, scans=scans)
    got = [tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in found.collect()]
    want = plain_clusters(kept(rows, 64), 12, 4)
    assert order(got) == order(want)
    assert scans[0] == len(want) and sum(scans[1:]) < 0.7 * len(want) * (len(scans) - 1)
    few = frame.filter("vec_id < 3")
    assert {r.distance for r in C.cluster_vectors(few, rounds=2).collect()} == {0}
    assert C.cluster_vectors(frame.limit(0)).count() == 0
    assert C.cluster_vectors(frame.filter("embedding is null")).count() == 0


def test_no_distance_shrinks_by_more_than_the_loosening():
    rng = np.random.default_rng(5)
    tightened = 0
    for trial in range(400):
        dims, k = int(rng.integers(1, 6)), int(rng.integers(2, 6))
        old = rng.normal(size=(k, dims)) * 10
        new = old + rng.normal(size=(k, dims)) * rng.choice([0.0, 0.5, 5, 30], size=(k, 1))
        radii = np.abs(rng.normal(size=k)) * rng.choice([0.0, 1.0, 8.0, 40.0], size=k)
        loss = C.loosening(old, new, radii)
        drift = np.sqrt(((new - old) ** 2).sum(axis=1))
        for i in range(k):
            at = rng.normal(size=(200, dims))
            at = at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-12) * rng.uniform(0.8, 1, size=(200, 1))
            x = old[i] + at * radii[i]
            for j in set(range(k)) - {i}:
                shrunk = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert shrunk.max() <= loss[i] + 1e-9
            most = max(drift[j] for j in range(k) if j != i)
            assert loss[i] <= most + 1e-5
            tightened += loss[i] < 0.9 * most
    assert tightened > 300


def test_nearest_is_exact_for_large_components():
    rng = np.random.default_rng(3)
    for most in (5, 300, 10**8):
        v, c = rng.integers(-most, most, size=(50, 64)), rng.integers(-most, most, size=(9, 64))
        c[4] = c[2]  # a tie
        best, first, second = C.nearest(v, c)
        for row, b, f, s in zip(v.tolist(), best, first, second, strict=True):
            sizes = sorted((squared(row, e), j) for j, e in enumerate(c.tolist()))
            assert (f, b) == sizes[0] and s == sizes[1][0]


def plain_codes(rows, parts, entries, rounds):
    width = len(rows[0][1]) // parts
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    split = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in rows]
    books = [[v[p * width : (p + 1) * width] for _, v, _ in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for pieces in split:
                members[first_nearest(pieces[p], books[p])].append(pieces[p])
            books[p] = replaced(books[p], members)
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    found = []
    for (vec_id, _, label), pieces in zip(rows, split, strict=True):
        near = [first_nearest(pieces[p], books[p]) for p in range(parts)]
        found.append((vec_id, "".join(f"{e:02x}" for e in near), sum(squared(pieces[p], books[p][e]) for p, e in enumerate(near)), label))
    return [(i, c, e, sum(f[2] for f in found if f[3] == label), digest) for i, c, e, label in found]


@pytest.mark.parametrize(("dims", "parts", "entries"), [(64, 16, 64), (32, 16, 20), (12, 4, 7)])
def test_codes_equal_brute_force(spark, dims, parts, entries):
    rows = awkward(dims)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = V.compress(frame, parts=parts, entries=entries)
    got = [tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in found.collect()]
    assert order(got) == order(plain_codes(kept(rows, dims), parts, entries, 2))


def test_codes_of_few_and_no_vectors(spark):
    frame = spark.createDataFrame(awkward(32), SCHEMA)
    assert V.compress(frame.limit(0)).count() == 0
    assert {r.error for r in V.compress(frame.filter("vec_id in (1, 2)")).collect()} == {0}
    assert V.compress(frame.filter("vec_id in (900, 901, 902, 903)")).count() == 0


def test_grid_keeps_what_fits_a_long():
    import pyarrow as pa

    limit = grid_limit(64)
    assert 64 * (2 * limit) ** 2 < 2**63
    vectors = pa.array([[limit / 256] * 64, [(limit + 1) / 256] * 64, None, [-0.001] * 64], pa.list_(pa.float64()))
    mask, v = on_grid(vectors.slice(0, 4), 64)
    assert mask.tolist() == [True, False, False, True] and v[0].tolist() == [limit] * 64 and v[1].tolist() == [-1] * 64
    mask, v = on_grid(vectors.slice(2, 2), 64)
    assert mask.tolist() == [False, True] and v.tolist() == [[-1] * 64]
    lists = pa.array([[1, 2], [3, 4], [5, 6]], pa.list_(pa.int32()))
    assert as_matrix(lists.slice(1, 2), 2).tolist() == [[3, 4], [5, 6]]
