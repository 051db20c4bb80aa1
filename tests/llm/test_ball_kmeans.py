"""Ball k-means against Lloyd's rounds in plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from lexiline.llm import op13_ball_kmeans
from lexiline.llm.op13_ball_kmeans import ball_kmeans, quantised

VECTORS = "vec_id long, embedding array<float>, label int, v string, cluster long, distance string"
SIZE = 6


def rows(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(SIZE)] for _ in range(7)]
    out = [(i, [float(np.float32(x + rng.gauss(0, 0.15))) for x in rng.choice(centres)], 1, "v", 2, "d") for i in range(n)]
    out += [(n + i, out[0][1], 1, "v", 2, "d") for i in range(n // 3)]  # a hot vector
    grid = [[float(x) for x in p] for p in ((0, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0), (0.5, 0, 0, 0, 0, 0), (1.5, 0, 0, 0, 0, 0))]
    out += [(5000 + i, p, 1, "v", 2, "d") for i, p in enumerate(grid * 4)]  # ties
    odd = [None, [], [1.0] * (SIZE - 1), [1.0] * (SIZE + 1), [None] + [1.0] * (SIZE - 1), [math.nan] + [1.0] * (SIZE - 1), [math.inf] + [1.0] * (SIZE - 1), [-math.inf] * SIZE]
    return out + [(9000 + i, x, None, None, None, None) for i, x in enumerate(odd)] + [(None, out[1][1], 1, "v", 2, "d"), (3, out[3][1], 1, "v", 2, "d")]


def lloyd(given, k, rounds):
    fine = [(i, [math.floor(256 * x) for x in e]) for i, e, *_ in given if e is not None and len(e) == SIZE and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(fine, key=key)[:k]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [assign(v)[1] for _, v in fine]
        for j in range(len(centroids)):
            if members := [v for (_, v), o in zip(fine, own) if o == j]:
                centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    return sorted(((-1 if i is None else i, *assign(v)[::-1]) for i, v in fine)), centroids


@pytest.mark.parametrize(("k", "rounds", "replay"), [(12, 5, 8), (12, 7, 2), (40, 5, 8), (1, 2, 8), (9, 0, 8)])
def test_clusters_are_those_of_all_distances(spark, monkeypatch, k, rounds, replay):
    monkeypatch.setattr(op13_ball_kmeans, "REPLAY", replay)
    monkeypatch.setattr(op13_ball_kmeans, "STEP", 50)
    given = rows(k, 120)
    found, centroids = ball_kmeans(quantised(spark.createDataFrame(given, VECTORS).repartition(3), SIZE), k, rounds, SIZE)
    want, ends = lloyd(given, k, rounds)
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()) == want
    assert centroids.tolist() == ends


def test_few_distances_are_computed(spark):
    given, counts = rows(2, 600), []
    ball_kmeans(quantised(spark.createDataFrame(given, VECTORS), SIZE), 40, 6, SIZE, counts=counts)
    assert len(counts) == 6 and counts[-1] < 0.4 * 40 * len(given)


def test_large_components_are_whole(spark):
    """Beyond what doubles hold exactly."""
    rng = random.Random(4)
    given = [(i, [float(np.float32(rng.uniform(-2.0**17, 2.0**17))) for _ in range(SIZE)], 1, "v", 2, "d") for i in range(40)]
    found, centroids = ball_kmeans(quantised(spark.createDataFrame(given, VECTORS), SIZE), 5, 3, SIZE)
    want, ends = lloyd(given, 5, 3)
    assert sorted(tuple(r) for r in found.collect()) == want and centroids.tolist() == ends
    with pytest.raises(PySparkException):
        quantised(spark.createDataFrame([(1, [1e30] * SIZE, 1, "v", 2, "d")], VECTORS), SIZE).collect()


def test_fewer_vectors_than_clusters_and_none(spark):
    given = rows(1, 3)[:3]
    found, centroids = ball_kmeans(quantised(spark.createDataFrame(given, VECTORS), SIZE), 40, 5, SIZE)
    assert len(centroids) == 3 and sorted(tuple(r) for r in found.collect()) == lloyd(given, 40, 5)[0]
    none, centroids = ball_kmeans(quantised(spark.createDataFrame([], VECTORS), SIZE), 40, 5, SIZE)
    assert none.collect() == [] and len(centroids) == 0 and none.columns == ["vec_id", "cluster", "distance"]
