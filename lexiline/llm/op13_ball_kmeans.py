"""Ball k-means over vectors of integers: exactly the clusters of Lloyd's rounds, with few distances computed.

A cluster is a ball: its centroid and a radius that no member lies beyond. Only centroids nearer than twice the radius are its neighbours. Of these,
by distance, the first bounds the stable core: a member that lies nearer to its own centroid than half the way to that neighbour stays. Beyond the core lie annuli; a
member in the m-th is compared with the m nearest neighbours only, exactly. Comparisons of bounds are strict and in whole numbers, so that a tie
is always compared, and goes to the centroid of the smaller number.

Centroids, radii and neighbours are k rows, however many vectors there are, and the driver holds them. Vectors aren't rewritten in each
round: a round reads the source and replays the rounds before it from their balls, so it has no state to lose, and what is shuffled are a few sums for each
task. After REPLAY rounds the clusters are written once, and rounds start from there. The radius of a round is the largest distance to the last
centroid and that centroid's move, rounded up.

Vectors count if they have exactly `size` components, none null, nan or infinite; a component x is floor(scale * x). If that lies beyond 2^26 the sum of squares
needn't fit a long, which is an error. A null vec_id counts as the text 'null' where first centroids are chosen, equal ids there by their components; every row is
clustered. Fewer vectors than k make fewer clusters, none make none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiline.llm.common import drop, materialise, table, workspace

#: rounds that are replayed before clusters are written, and rows that a task compares at once
REPLAY, STEP = 8, 4096
#: components up to which every sum of squares fits a long, and up to which sums of products are whole in doubles
MOST, EXACT = 1 << 26, 1 << 22


def quantised(vectors: DataFrame, size: int = 64, scale: float = 256.0) -> DataFrame:
    """(vec_id, v): the vectors that count, as arrays of whole numbers."""
    x: Column = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.select("vec_id", "embedding").filter((F.size(x) == size) & fine)
    too_far = F.exists(x, lambda c: F.abs(c.cast("double")) * scale > MOST)
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return kept.select("vec_id", F.when(too_far, F.raise_error(F.lit(f"a component beyond 2^26 / {scale}: squared distances needn't fit a long")).cast("array<bigint>")).otherwise(v).alias("v"))


@dataclass
class Balls:
    """Centroids (k x size), and for each its neighbours in ascending order of (distance, number), with these squared distances."""

    centroids: np.ndarray
    near: list[np.ndarray]
    far: list[np.ndarray]

    @classmethod
    def of(cls, centroids: np.ndarray, radii: list[int | None]) -> Balls:
        """radii: a length that no member lies beyond; None if nothing is known, so that all centroids are neighbours."""
        apart = ((centroids[:, None] - centroids[None]) ** 2).sum(axis=2)
        near, far = [], []
        for i, radius in enumerate(radii):
            order = np.lexsort((np.arange(len(apart)), apart[i]))
            order = order[order != i]
            if radius is not None:  # half the way is within the ball; whole numbers without a limit
                order = order[[int(d) <= 4 * radius * radius for d in apart[i][order]]]
            near.append(order)
            far.append(apart[i][order])
        return cls(centroids, near, far)

    def assign(self, v: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of vectors that are in these clusters now, the squared distances, and how many distances were computed."""
        plain = v.astype(np.float64) if np.abs(v).max(initial=0) <= EXACT and np.abs(self.centroids).max(initial=0) <= EXACT else None
        mine = v - self.centroids[cluster]
        best, distance, computed = cluster.copy(), (mine * mine).sum(axis=1), len(v)
        own = distance.copy()
        squares = (v * v).sum(axis=1)
        for i in np.unique(cluster):
            at = np.flatnonzero(cluster == i)
            # annulus of each member: as many neighbours as may be as near as its own centroid
            annulus = np.searchsorted(self.far[i], 4 * own[at], side="right")
            at, annulus = at[annulus > 0], annulus[annulus > 0]
            order = np.argsort(-annulus, kind="stable")
            at, annulus = at[order], annulus[order]
            for m, j in enumerate(self.near[i][: annulus[0] if len(annulus) else 0].tolist()):
                some = at[: np.searchsorted(-annulus, -m, side="left")]  # those in the annulus m + 1 and beyond
                c = self.centroids[j]
                product = (plain[some] @ c.astype(np.float64)).astype(np.int64) if plain is not None else v[some] @ c
                d = squares[some] - 2 * product + int(c @ c)
                computed += len(some)
                nearer = (d < distance[some]) | (d == distance[some]) & (j < best[some])
                distance[some] = np.where(nearer, d, distance[some])
                best[some] = np.where(nearer, j, best[some])
        return best, distance, computed


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def replayed(rounds: list[Balls], batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Batches of vectors with their clusters and squared distances after these rounds."""
    for whole in batches:
        for a in range(0, whole.num_rows, STEP):
            batch = whole.slice(a, STEP)
            v = _matrix(batch.column("v"), size)
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            distance, computed = np.zeros(len(v), np.int64), 0
            for balls in rounds:
                cluster, distance, n = balls.assign(v, cluster)
                computed += n
            yield batch, v, cluster, distance, computed


SUMS = "cluster int, n long, most long, sums array<bigint>, computed long"


def summed(vectors: DataFrame, rounds: list[Balls], size: int) -> list[tuple]:
    """Of each cluster after these rounds: members, largest squared distance, sums of components, distances computed."""
    k = len(rounds[-1].centroids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most, sums, computed = np.zeros(k, np.int64), np.full(k, -1, np.int64), np.zeros((k, size), np.int64), 0
        for _, v, cluster, distance, done in replayed(rounds, batches, size):
            n += np.bincount(cluster, minlength=k)
            np.maximum.at(most, cluster, distance)
            np.add.at(sums, cluster, v)
            computed += done
        full = np.flatnonzero(n)
        rows = {"cluster": pa.array(full, pa.int32()), "n": n[full], "most": most[full], "sums": pa.array(sums[full].tolist(), pa.list_(pa.int64())), "computed": [computed if i == 0 else 0 for i in range(len(full))]}
        yield pa.RecordBatch.from_pydict(rows)

    parts = vectors.mapInArrow(task, SUMS)
    added = F.array(*[F.sum(F.col("sums")[i]) for i in range(size)])
    return [tuple(r) for r in parts.groupBy("cluster").agg(F.sum("n"), F.max("most"), added, F.sum("computed")).collect()]  # a row for each cluster


def first_centroids(vectors: DataFrame, k: int, seed: int = 2) -> np.ndarray:
    """The k vectors whose numbers have the smallest hashes, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return np.array([r["v"] for r in vectors.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()], np.int64)  # k rows


CLUSTERED = "vec_id long, cluster int, distance long"


def ball_kmeans(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2, counts: list[int] | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of quantised vectors (vec_id, v), and the final centroids. `counts` gets the number of distances of each round but the last."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    start = vectors.select("vec_id", "v", F.lit(0).alias("cluster"))
    done, place, written, before = [Balls.of(centroids, [None] * len(centroids))], workspace(spark), 0, 0
    for _ in range(rounds):
        if len(done) > REPLAY:
            start = materialise(_clustered(start, done[:-1], size, True), place, f"clusters{written}")
            if written:
                drop(place, spark, f"clusters{written - 1}")
            done, written, before = done[-1:], written + 1, 0
        found = summed(start, done, size)
        if counts is not None:
            total = sum(row[4] for row in found)
            counts.append(total - before)
            before = total
        after, radii = centroids.copy(), [0] * len(centroids)
        for cluster, n, most, sums, _ in found:
            after[cluster] = [s // n for s in sums]  # Python's integers: floor of the exact quotient
            moved = int(((after[cluster] - centroids[cluster]) ** 2).sum())
            radii[cluster] = math.isqrt(most) + math.isqrt(moved) + 2
        centroids = after
        done.append(Balls.of(centroids, radii))
    return _clustered(start, done, size, False), centroids


def _clustered(vectors: DataFrame, rounds: list[Balls], size: int, with_vectors: bool) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, distance, _ in replayed(rounds, batches, size):
            vec_id, own = batch.column("vec_id"), pa.array(cluster, pa.int32())
            yield pa.RecordBatch.from_arrays([vec_id, batch.column("v"), own], ["vec_id", "v", "cluster"]) if with_vectors else pa.RecordBatch.from_arrays([vec_id, own, pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.withColumn("vec_id", F.col("vec_id").cast("long")).mapInArrow(task, "vec_id long, v array<bigint>, cluster int" if with_vectors else CLUSTERED)


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = ball_kmeans(quantised(table(spark, sf_dir, "embeddings")))
    found = materialise(found, workspace(spark), "clustered")
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]  # k rows
    own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = own.agg(F.sum("cluster_inertia").alias("inertia"))
    of = own.crossJoin(F.broadcast(whole)).join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")  # a row for each cluster
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    steps = [
        "q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), v) - 1 AS c, v AS m FROM q QUALIFY c < 40)",
    ]
    # doubles hold these whole numbers exactly
    square = "(list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m))::BIGINT"
    for i in range(6):
        steps.append(f"a{i} AS (SELECT q.vec_id, any_value(q.v) AS v, arg_min(c, {square} * 64 + c) AS c, min({square}) AS d FROM q, c{i} GROUP BY q.vec_id)")
        if i < 5:
            steps += [
                f"u{i} AS (SELECT c, i, sum(x::BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY c, i)",
                f"n{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS m FROM u{i} GROUP BY c)",
                f"c{i + 1} AS (SELECT c{i}.c, coalesce(n{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN n{i} ON n{i}.c = c{i}.c)",
            ]
    digest = "sha256(array_to_string(list_transform(m, lambda x: x::BIGINT::VARCHAR), ','))"
    return f"WITH {', '.join(steps)} SELECT vec_id, a5.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a5.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, {digest} AS centroid_sha256 FROM a5 JOIN c5 ON c5.c = a5.c"


#: Lloyd's rounds as they stand, every distance computed
ORACLE_SQL = _oracle()
