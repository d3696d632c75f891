"""Clustering around centroids, each vector assigned by the threshold algorithm.

Every dimension holds the centroids sorted by their value there.  A vector's own value is
found in each list, and the lists are walked outward from it, nearest entry first.  A
centroid met for the first time gets its exact distance.  The frontier, the distance of the
entry last met in each list, bounds every centroid not met yet from below: once the sum of
the squared frontiers strictly exceeds the best exact distance, no centroid that is left can
be as near, ties included, and the walk ends.

All arithmetic is on integers.  A round is one pass over the vectors; what leaves a task is
the sum and the number of the vectors of each centroid, so the driver only ever holds the
centroids, whose number and length are parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.session import written

#: Centroids, rounds, length of a vector and steps of the grid in a unit.
CENTROIDS, ROUNDS, LENGTH, STEPS = 40, 5, 64, 256
#: Largest value on the grid either way; distances within it fit 64 bits.
GRID = 2**27
#: Vectors that are walked together.
TILE = 4096


def sorted_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, values): per dimension the centroids by value, with an open end on both sides."""
    order = np.argsort(centroids, axis=0, kind="stable")
    open_end = np.full((1, centroids.shape[1]), 4 * GRID)
    return order, np.concatenate([-open_end, np.take_along_axis(centroids, order, axis=0), open_end])


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row; ties go to the smaller number."""
    n, k = len(vectors), len(centroids)
    order, values = sorted_lists(centroids)
    dims = np.arange(vectors.shape[1])
    right = np.stack([np.searchsorted(values[1:-1, d], vectors[:, d]) for d in dims], axis=1) + 1
    left = right - 1
    best, number = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    met = np.zeros((n, k), bool)
    rows = np.arange(n)
    while len(rows):
        own, lo, hi = vectors[rows], left[rows], right[rows]
        down, up = own - values[lo, dims], values[hi, dims] - own
        lower = down <= up
        entry = order[np.where(lower, lo, hi) - 1, dims]  # both lists have an entry left while a centroid is not met
        left[rows], right[rows] = lo - lower, hi + ~lower
        seen = np.zeros((len(rows), k), bool)
        seen[np.arange(len(rows))[:, None], entry] = True
        fresh = seen & ~met[rows]
        met[rows] |= seen
        for c in np.flatnonzero(fresh.any(axis=0)):
            at = rows[fresh[:, c]]
            off = vectors[at] - centroids[c]
            distance = np.einsum("ij,ij->i", off, off)
            nearer = (distance < best[at]) | ((distance == best[at]) & (c < number[at]))
            best[at[nearer]], number[at[nearer]] = distance[nearer], c
        frontier = np.minimum(down, up)
        rows = rows[(np.einsum("ij,ij->i", frontier, frontier) <= best[rows]) & ~met[rows].all(axis=1)]
    return number, best


def tiles(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, vectors) of the ``vector`` column of a batch, as 64-bit integers."""
    column = batch.column("vector")
    values = np.asarray(column.flatten()).reshape(-1, length)
    for at in range(0, len(values), TILE):
        yield at, values[at:at + TILE].astype(np.int64)


def on_grid(vectors: DataFrame, length: int = LENGTH, steps: int = STEPS) -> DataFrame:
    """(vec_id, vector array<int>): vectors of ``length`` finite components, each floored to the grid; null outside it."""
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.size("e") == length)
    finite = F.forall("e", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    inside = F.forall("e", lambda x: F.abs(x) * steps < GRID)
    return plain.where(finite).select("vec_id", F.when(inside, F.transform("e", lambda x: F.floor(x * steps).cast("int"))).alias("vector"))


def first_centroids(vectors: DataFrame, count: int = CENTROIDS) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, at most ``count``."""
    key = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.where("vector is not null").select(key.alias("key"), "vector").orderBy("key", "vector").limit(count).collect()
    return np.array([r["vector"] for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each centroid replaced by the floored mean of its vectors, one without vectors left as it is."""
    k, length = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, length), np.int64)
        for batch in batches:
            for _, tile in tiles(batch, length):
                number, _ = nearest(tile, centroids)
                count += np.bincount(number, minlength=k)
                np.add.at(total, number, tile)
        used = np.flatnonzero(count)
        parts = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * length, pa.int32()), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), parts], ["cluster", "n", "total"])

    partial = vectors.select("vector").mapInArrow(sums, "cluster long, n long, total array<long>")
    whole = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"d{d}") for d in range(length)])
    out = centroids.copy()
    for row in whole.collect():  # at most one row per centroid
        out[row["cluster"]] = [int(row[f"d{d}"]) // row["n"] for d in range(length)]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every row of ``vectors`` (vec_id, vector)."""
    length = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, tile in tiles(batch, length):
                number, distance = nearest(tile, centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").slice(at, len(tile)), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "vector").mapInArrow(assign, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, length: int = LENGTH, steps: int = STEPS) -> DataFrame:
    """Cluster the rows of ``vectors`` (vec_id, embedding; other columns are ignored).

    Only vectors of ``length`` components, none null or non-finite, are kept; a component x
    becomes the integer floor(``steps`` * x).  The first centroids are the ``count`` kept
    vectors whose ids have the smallest hashes, in that order (all, if there are fewer).
    Each of ``rounds`` rounds assigns every vector to its nearest centroid and moves the
    centroids to the floored means; at the end vectors are assigned once more.  Returns
    (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per kept
    vector.

    Null, empty and longer or shorter vectors are not kept; ties in distance go to the
    smaller number; rows that repeat an id are vectors of their own, ordered by value where
    ids tie; a null id hashes as the empty text; an empty table gives no rows.  A vector
    with a component beyond ``GRID`` steps has no distance of 64 bits: it is returned with
    null in all columns but vec_id and moves no centroid.
    """
    spark = vectors.sparkSession
    grid = written(on_grid(vectors, length, steps), "centroid-grid")
    inside, outside = grid.where("vector is not null"), grid.where("vector is null")
    centroids = first_centroids(grid, count)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    missing = outside.select("vec_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (part.split() for part in schema.split(", ")[1:])])
    if not len(centroids):  # no vector on the grid
        return missing
    for _ in range(rounds):
        centroids = moved(inside, centroids)
    placed = written(assigned(inside, centroids), "centroid-assigned")
    sums = dict(map(tuple, placed.groupBy("cluster").agg(F.sum("distance")).collect()))  # at most one row per centroid
    names = [hashlib.sha256(",".join(map(str, own)).encode()).hexdigest() for own in centroids.tolist()]
    rows = [(c, own, sum(sums.values()), names[c]) for c, own in sums.items()]
    whole = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    named = placed.join(F.broadcast(whole), "cluster")
    return named.select([part.split()[0] for part in schema.split(", ")]).unionByName(missing)
