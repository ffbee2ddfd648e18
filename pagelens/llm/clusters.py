"""Centroid clustering with lower bounds tightened by planar geometry.

Every vector carries its centroid, an upper bound of the distance to it and a lower bound of
the distance to any other centroid. When centroids move,

* the upper bound grows by the drift of the vector's own centroid;
* the lower bound is loosened by less than the largest drift. A cluster's vectors lie in a
  sphere around its old centroid o. For another centroid that moves from a to b, the distance
  from a point x of the sphere changes along the way by the cosine of the angle between the
  way and the line from x. In the plane of o, a and b the worst such line is a tangent of the
  sphere, so the loss is at most the shortening of a string from the moving centroid that is
  laid around the sphere: ``string_loss`` has it in closed form. It is negative for a centroid
  that moves away, and about drift * cos(angle) for one that passes at a distance.

A vector whose lower bound still exceeds its upper bound keeps its centroid unseen. For the
others the distance to the own centroid is computed, and if that doesn't settle it all
distances are, exactly in integers. So the result is that of the plain algorithm, ties to the
smaller number included; bounds are widened by far more than their rounding errors.

Spark writes one version of the vectors with their bounds a round and removes the one before.
Sums change by the vectors that moved only. What meets the driver is one row for each
cluster and component, and centroids and clusters have a fixed number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.vectors import Replaced, as_lists, as_matrix, digest, grid_vectors, totals
from pagelens.llm.words import narrow_batches, written

CLUSTERS = 40
ROUNDS = 5
DIMS = 64
SEED = 2
# Bounds are widened by this part of the lengths they come from.
SLACK = 1e-9

STATE = "vec_id bigint, v array<int>, cluster int, was int, upper double, lower double, scanned boolean"


def string_loss(along_from: np.ndarray, along_to: np.ndarray, height: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much the distance from a point of a sphere to a moving point can shrink, at most.

    The sphere lies around the origin; the point moves on a line at ``height`` from it, from
    ``along_from`` to ``along_to`` as measured from the foot of the perpendicular. Where the
    line meets the sphere, the loss is the full way up to the point where it leaves it.
    """
    # A line that meets the sphere has no tangent argument before it has left the sphere behind.
    leaves = np.where(height > radius, -np.inf, np.sqrt(np.maximum(radius**2 - height**2, 0)))
    begin = np.clip(leaves, along_from, along_to)

    def string(s):
        far = np.hypot(s, height)
        tangent = np.sqrt(np.maximum(far**2 - radius**2, 0))
        # Direction of the tangent on the far side, measured from the way.
        angle = np.arctan2(height, s) + np.arcsin(np.clip(np.divide(radius, far, out=np.ones_like(far), where=far > 0), 0, 1))
        return tangent + radius * angle

    return (begin - along_from) + np.where(begin < along_to, string(begin) - string(along_to), 0)


def loosening(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each cluster, the most that the distance of its vectors to another centroid can shrink."""
    old, new = old.astype(float), new.astype(float)
    move = new - old
    drift = np.sqrt((move**2).sum(axis=1))
    k = len(old)
    unit = np.divide(move, drift[:, None], out=np.zeros_like(move), where=drift[:, None] > 0)
    apart = old[None, :, :] - old[:, None, :]  # from the sphere's centre to the moving centroid
    along = np.einsum("ijd,jd->ij", apart, unit)
    height = np.sqrt(np.maximum((apart**2).sum(axis=2) - along**2, 0))
    radius = np.broadcast_to(radii[:, None], (k, k))
    end = along + drift[None, :]
    loss = np.minimum(string_loss(along, end, height, radius), np.broadcast_to(drift, (k, k)))
    loss += SLACK * (1 + height + np.abs(along) + np.abs(end) + radius)
    loss[:, drift == 0] = 0.0
    np.fill_diagonal(loss, -np.inf)
    return loss.max(axis=1)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid, its squared distance and that of the second nearest (-1: none)."""
    v, centroids = v.astype(np.int64), centroids.astype(np.int64)
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if v.shape[1] * (2 * most) ** 2 < 2**53:  # exact in doubles
        x, c = v.astype(float), centroids.astype(float)
        squared = ((x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)).astype(np.int64)
    else:
        squared = np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = squared.argmin(axis=1)
    rows = np.arange(len(v))
    first = squared[rows, best]
    if len(centroids) == 1:
        return best, first, np.full(len(v), -1)
    squared[rows, best] = np.iinfo(np.int64).max
    return best, first, squared.min(axis=1)


def reassign(v, cluster, upper, lower, centroids, drift, loss):
    """cluster, upper, lower, scanned after the centroids moved; cluster -1 is not assigned yet."""
    cluster = cluster.copy()
    fresh = cluster < 0
    upper = np.where(fresh, np.inf, upper + drift[cluster])
    lower = np.where(fresh, -np.inf, lower - loss[cluster])
    open_ = np.flatnonzero(~(lower > upper) & ~fresh)
    own = ((v[open_] - centroids[cluster[open_]]) ** 2).sum(axis=1)
    upper[open_] = np.sqrt(own.astype(float)) * (1 + SLACK)
    scanned = ~(lower > upper)
    at = np.flatnonzero(scanned)
    if len(at):
        best, first, second = nearest(v[at], centroids)
        cluster[at], upper[at] = best, np.sqrt(first.astype(float)) * (1 + SLACK)
        lower[at] = np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0).astype(float)) * (1 - SLACK))
    return cluster, upper, lower, scanned


def _assigned(state: DataFrame, centroids: np.ndarray, drift: np.ndarray, loss: np.ndarray) -> DataFrame:
    dims = centroids.shape[1]
    sent = state.sparkSession.sparkContext.broadcast((centroids, drift, loss))

    def assign(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            v, was = as_matrix(batch.column("v"), dims), np.asarray(batch.column("cluster"))
            bounds = (np.asarray(batch.column(c)) for c in ("upper", "lower"))
            cluster, upper, lower, scanned = reassign(v, was, *bounds, *sent.value)
            found = [pa.array(cluster.astype(np.int32)), pa.array(was), pa.array(upper), pa.array(lower), pa.array(scanned)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), *found], names=["vec_id", "v", "cluster", "was", "upper", "lower", "scanned"]
            )

    return narrow_batches(state).mapInArrow(assign, STATE)


def _changes(state: DataFrame, clusters: int, dims: int) -> DataFrame:
    """What each component's sum (and, at place ``dims``, the count) of a cluster gains; place, slot, total."""

    def count(batches):
        gained = np.zeros((clusters, dims + 1), dtype=np.int64)
        for batch in batches:
            v = np.hstack([as_matrix(batch.column("v"), dims), np.ones((batch.num_rows, 1), dtype=np.int64)])
            cluster, was = np.asarray(batch.column("cluster")), np.asarray(batch.column("was"))
            np.add.at(gained, cluster, v)
            np.subtract.at(gained, was[was >= 0], v[was >= 0])
        slot, place = np.nonzero(gained)
        columns = [pa.array(c) for c in (place.astype(np.int32), slot.astype(np.int32), gained[slot, place])]
        yield pa.RecordBatch.from_arrays(columns, names=["place", "slot", "total"])

    moved = state.filter("cluster <> was").select("v", "cluster", "was")
    return narrow_batches(moved).mapInArrow(count, "place int, slot int, total bigint")


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of ``seed:vec_id``; null ids come last, ties go to the smaller vector."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def cluster_vectors(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scans: list | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and centroid for every kept row.

    rows: vec_id, embedding; other columns are not read. Kept are vectors of exactly ``dims``
    components, none null or not finite; a component beyond ``grid_limit`` (741,455 for 64
    components: squared distances would not fit a long) counts as not finite. Repeated rows
    are vectors of their own; a null vec_id starts a centroid only if too few others are there.
    Fewer vectors than clusters make as many clusters as vectors, none make no rows. A sum
    beyond a long is null. ``scans`` collects how many vectors each pass compared with all centroids.
    """
    spark = rows.sparkSession
    table = Replaced(spark, "clusters")
    start = grid_vectors(rows, dims).select(
        "vec_id", "v", F.lit(-1).alias("cluster"), F.lit(-1).alias("was"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(False).alias("scanned")
    )
    state = table.write(start)
    centroids = first_centroids(state, clusters)
    k = len(centroids)
    if not k:
        centroids = np.zeros((0, dims), dtype=np.int64)
    drift, loss = np.zeros(k), np.zeros(k)
    sums = [[0] * (dims + 1) for _ in range(k)]
    for _ in range(rounds if k else 0):
        state = table.write(_assigned(state, centroids, drift, loss))
        if scans is not None:
            scans.append(state.filter("scanned").count())
        for place, slot, total in totals(_changes(state, k, dims)):
            sums[slot][place] += total
        radii = np.zeros(k)
        for r in state.groupBy("cluster").agg(F.max("upper").alias("upper")).collect():
            radii[r["cluster"]] = r.upper
        moved = np.array([[s // row[dims] for s in row[:dims]] if row[dims] else c for row, c in zip(sums, centroids.tolist(), strict=True)])
        drift = np.sqrt(((moved - centroids).astype(float) ** 2).sum(axis=1)) * (1 + SLACK)
        loss = loosening(centroids, moved, radii)
        centroids = moved

    final = spark.sparkContext.broadcast(centroids)

    def distances(batches):
        for batch in batches:
            v, cluster = as_matrix(batch.column("v"), dims), np.asarray(batch.column("cluster"))
            squared = ((v - final.value[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(squared)], names=["vec_id", "cluster", "distance"])

    state = table.write(_assigned(state, centroids, drift, loss))
    if scans is not None:
        scans.append(state.filter("scanned").count())
    found = written(narrow_batches(state).mapInArrow(distances, "vec_id bigint, cluster int, distance bigint"), "clustered")
    table.remove()
    inertia = {r["cluster"]: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def as_long(n: int) -> int | None:
        return n if n < 2**63 else None

    # One row for each cluster, of which there are ``clusters`` at most.
    whole = as_long(sum(inertia.values()))
    described = [(c, as_long(s), whole, digest(centroids[c].tolist()), centroids[c].tolist()) for c, s in inertia.items()]
    schema = "number int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>"
    joined = found.join(F.broadcast(spark.createDataFrame(described, schema)), F.col("cluster") == F.col("number"))
    return joined.drop("number")


def sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> str:
    """The plain algorithm."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range({dims})) AS d FROM v),
c0 AS MATERIALIZED (
  SELECT j, unnest(v) AS c, unnest(range({dims})) AS d FROM (
    SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS j, v FROM v) WHERE j < {clusters})"""]
    for t in range(rounds + 1):
        steps.append(f"""
a{t} AS MATERIALIZED (
  SELECT r, arg_min(j, (s, j)) AS j, min(s) AS s FROM (
    SELECT r, j, sum((x - c) * (x - c))::BIGINT AS s FROM x JOIN c{t} USING (d) GROUP BY r, j) GROUP BY r)""")
        if t < rounds:
            steps.append(f"""
m{t} AS MATERIALIZED (SELECT j, d, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{t} USING (r) GROUP BY j, d),
c{t + 1} AS MATERIALIZED (SELECT j, d, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{t} LEFT JOIN m{t} USING (j, d))""")
    steps.append(f"""
h AS (SELECT j, sha256(string_agg(c::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY j)
SELECT vec_id, j::INT AS cluster, s AS distance, (sum(s) OVER (PARTITION BY j))::BIGINT AS cluster_inertia,
  (sum(s) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN h USING (j)""")
    return "WITH" + ",".join(steps[:-1]) + "," + steps[-1]
