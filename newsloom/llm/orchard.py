"""Centroid clustering: Lloyd's rounds in whole numbers, assigned by Orchard's search.

Each component x becomes floor(scale * x). The first centroids are the vectors with the smallest sha256 of their salted ids. A round assigns every vector to its nearest
centroid (squared Euclidean distance, ties to the smaller number) and replaces each centroid by the floor of its vectors' mean; one without vectors stays. Then all are assigned once more.

Orchard's search holds, for every centroid, the others in the order of their distance from it. A vector starts at a centroid that few components
suggest and walks along its list; at a nearer one (or as near with a smaller number) it jumps to that one's list. What it has met it passes over, and
it stops where the list is strictly beyond twice the distance of its own centroid: nothing behind can be as near. All rows of a batch walk together.

Each task sums its vectors by centroid, so that a round shuffles as many rows as there are tasks and centroids; the centroids (k of them, a parameter) are all
that the driver and the tasks hold. Vectors are read anew in each round.

Defined results: vectors of another dimension, null ones, and ones with null or non-finite components take no part; neither do ones with a component so large that
squared distances may not fit 64 bits (beyond 2^19 at 64 dimensions and scale 256). Rows without an id are assigned, but start no centroid. Rows that repeat are rows of their own;
of equal hashes the smaller vector comes first. With fewer vectors than k there are as many centroids. An empty table gives an empty one. A sum of distances beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

K, ROUNDS, SCALE, DIMENSION, SALT = 40, 5, 256, 64, "2:"
#: Every so many-th component suggests where to start.
COARSE = 8


def whole_numbers(v: Column, scale: int, largest: int) -> Column:
    """Whether a vector of doubles has only components whose scaled floors are at most so large; not so for null and non-finite ones."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: (F.floor(x * scale) >= -largest) & (F.floor(x * scale) <= largest) & ~F.isnan(x)), F.lit(False))


def rows_of(batch: pa.RecordBatch, scale: int) -> np.ndarray:
    """The vectors of a batch, of one dimension, as rows of whole numbers."""
    v = batch.column("v")
    flat, offsets = v.values.to_numpy(), v.offsets.to_numpy()
    return np.floor(flat[offsets[0] : offsets[-1]] * scale).astype(np.int64).reshape(batch.num_rows, -1)


class Centroids:
    """Centroids with their neighbour lists."""

    def __init__(self, at: np.ndarray):
        self.at = at
        apart = ((at[:, None] - at[None]) ** 2).sum(axis=2)
        np.fill_diagonal(apart, -1)
        self.order = np.argsort(apart, axis=1, kind="stable")
        # an ordered list's squared distances over four, rounded up: beyond a squared distance d, the centroid is beyond twice its root
        self.reach = (np.take_along_axis(apart, self.order, axis=1) + 3) // 4

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The number and squared distance of each row's nearest centroid, and how many distances that took."""
        n, k = len(x), len(self.at)
        rough = ((x[:, None, ::COARSE] - self.at[None, :, ::COARSE]) ** 2).sum(axis=2)
        own = rough.argmin(axis=1)
        best = ((x - self.at[own]) ** 2).sum(axis=1)
        met = np.zeros((n, k), bool)
        met[np.arange(n), own] = True
        place = np.ones(n, np.int64)  # in the list of the own centroid, which begins with itself
        live = np.arange(n)
        taken = n
        while True:
            live = live[place[live] < k]
            live = live[self.reach[own[live], place[live]] <= best[live]]
            if not len(live):
                return own, best, taken
            other = self.order[own[live], place[live]]
            place[live] += 1
            fresh = ~met[live, other]
            row, other = live[fresh], other[fresh]
            met[row, other] = True
            d = ((x[row] - self.at[other]) ** 2).sum(axis=1)
            taken += len(row)
            nearer = (d < best[row]) | ((d == best[row]) & (other < own[row]))
            jumps = row[nearer]
            own[jumps], best[jumps], place[jumps] = other[nearer], d[nearer], 1


def _sums(centroids: Centroids, scale: int):
    """A task's number of vectors and sums of components for each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.at.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch, scale)
                own, _, _ = centroids.nearest(x)
                count += np.bincount(own, minlength=k)
                np.add.at(total, own, x)
        used = np.flatnonzero(count)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assigned(centroids: Centroids, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, best, _ = centroids.nearest(rows_of(batch, scale))
                yield pa.record_batch([batch.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dimension: int = DIMENSION, salt: str = SALT) -> DataFrame:
    """vec_id, cluster, distance (squared), the sums of distances of its cluster and of all, and the digest of its centroid, for every row of vectors (vec_id, embedding) that takes part."""
    spark = vectors.sparkSession
    largest = math.isqrt(2**62 // dimension) // 2
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    x = x.filter(whole_numbers(F.col("v"), scale, largest) & (F.size("v") == dimension))
    hashed = x.filter("vec_id is not null").select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("hash"), "v")
    first = hashed.orderBy("hash", "v").limit(k).collect()  # k rows
    if not first:
        return x.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256")).filter("false")
    centroids = Centroids(np.floor(np.array([r.v for r in first]) * scale).astype(np.int64))
    for _ in range(rounds):
        parts = x.mapInArrow(_sums(centroids, scale), "cluster int, n long, sums array<long>")
        sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(dimension))).alias("sums"))
        at = centroids.at.copy()
        for r in sums.collect():  # k rows
            at[r.cluster] = [int(s) // r.n for s in r.sums]
        centroids = Centroids(at)
    assigned = saved(x.mapInArrow(_assigned(centroids, scale), "vec_id long, cluster int, distance long"))
    totals = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # k rows
    fits = lambda n: n if n < 2**63 else None
    everything = fits(sum(int(r.total) for r in totals))
    rows = [(r.cluster, fits(int(r.total)), everything, hashlib.sha256(",".join(map(str, centroids.at[r.cluster].tolist())).encode()).hexdigest()) for r in totals]
    figures = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql() -> str:
    """DuckDB SQL for cluster() of the table embeddings with the production parameters."""
    square = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}' || CAST(vec_id AS VARCHAR))) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL ORDER BY c LIMIT {K})",
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, v, m.c AS cluster, m.d AS distance FROM (
                SELECT k.vec_id, k.v, min({{'d': CAST({square} AS BIGINT), 'c': c.c}}) AS m FROM kept AS k CROSS JOIN c{r} AS c GROUP BY k.vec_id, k.v) AS x)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r} AS c LEFT JOIN (
                    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
                        SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({DIMENSION})) AS i FROM a{r}) AS u GROUP BY cluster, i) AS t
                    GROUP BY cluster) AS n ON n.cluster = c.c)"""
            )
    last = f"a{ROUNDS}"
    return f"""WITH {", ".join(steps)}
        SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM {last} AS a JOIN c{ROUNDS} AS c ON c.c = a.cluster"""
