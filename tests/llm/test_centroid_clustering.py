"""Sharded k-means against the plain one in unbounded integers."""

import hashlib
import math

import numpy as np
import pytest

from citesift.llm import centroid_clustering
from citesift.llm.centroid_clustering import LONG

SCHEMA = "vec_id long, embedding array<double>, block string, shard string, cluster string, n string"


def _brute(rows, k, rounds, width, scale=1024.0, seed="3"):
    kept = [
        (i, [math.floor(x * scale) for x in v])
        for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    vectors = np.array([v for _, v in kept], object)
    centroids = np.array([v for _, v in named[:k]], object)

    def nearest():
        d = np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)
        return [min(range(len(centroids)), key=lambda j: (line[j], j)) for line in d], d

    for _ in range(rounds):
        of = np.array(nearest()[0])
        for j in range(len(centroids)):
            if (of == j).any():
                centroids[j] = vectors[of == j].sum(axis=0) // int((of == j).sum())
    of, d = nearest()
    least = [line[j] for line, j in zip(d, of)]
    own = [sum(x for x, y in zip(least, of) if y == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    cut = lambda x: min(int(x), LONG)
    return sorted((i or 0, j, cut(x), cut(own[j]), cut(sum(least)), digest[j]) for (i, _), x, j in zip(kept, least, of))


def _clustered(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    return sorted(tuple(x or 0 for x in r) for r in centroid_clustering.cluster(frame, **options).collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(centroid_clustering, "BLOCK", 7)
    monkeypatch.setattr(centroid_clustering, "SHARD", 3)


def test_shards_ties_repeats_and_odd_rows(spark, small_blocks):
    rng = np.random.default_rng(4)
    # Few different values, so that distances tie.
    rows = [(int(i), [float(x) / 1024 for x in rng.integers(-2, 3, 8)]) for i in rng.integers(0, 150, 200)]
    rows += [(500 + i, [0.5] * 8) for i in range(100)]
    rows += [(None, [0.25] * 8), (901, None), (902, []), (903, [1.0] * 7), (904, [None] * 8), (905, [math.nan] * 8)]
    assert _clustered(spark, rows, k=5, rounds=4, width=8) == _brute(rows, 5, 4, 8)


@pytest.mark.parametrize("size", [1e5, 1e9, 1e13])
def test_exact_at_every_magnitude(spark, small_blocks, size):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4) * size]) for i in range(60)]
    assert _clustered(spark, rows, k=3, rounds=3, width=4) == _brute(rows, 3, 3, 4)


def test_an_empty_cluster_keeps_its_centroid(spark):
    # Two equal initial centroids: all rows go to the first.
    rows = [(1, [1.0]), (1, [1.0]), (1, [1.0])]
    got = _clustered(spark, rows, k=2, rounds=2, width=1)
    assert got == _brute(rows, 2, 2, 1) and {r[1] for r in got} == {0}


def test_fewer_rows_than_centroids_and_none(spark):
    assert len(_clustered(spark, [(1, [1.0]), (2, [3.0])], k=8, rounds=3, width=1)) == 2
    assert _clustered(spark, [], k=8, width=1) == []
    assert _clustered(spark, [(None, [1.0])], k=8, width=1) == []


def test_the_shards_never_move(spark):
    rows = spark.createDataFrame([(i, [float(i)] * 64) for i in range(50)], "vec_id long, embedding array<double>")
    vectors = centroid_clustering.usable(rows, 64)
    shards = centroid_clustering.Shards(vectors, 64, 1024.0)
    centroids = centroid_clustering.initial(vectors, 8, "3", 1024.0)
    plan = shards.sums(shards.nearest(centroids), 8)._jdf.queryExecution().executedPlan().toString()
    shards.drop()
    left = plan.split("SortMergeJoin")[1].split("FileScan")[1]
    assert "Bucketed: true" in left
    # By cluster, by shard and block for the assignments, by block for the partial distances.
    assert plan.count("Exchange hashpartitioning") == 3
