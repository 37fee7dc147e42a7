"""Orchard search and the clustering around it, against plain brute force in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from claimloom.llm import centroids


def nearest(v, around):
    return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(around))


def brute(rows, k, rounds, seed, dimensions, scale):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in kept]
    around = [[math.floor(scale * x) for x in v] for _, v in order[:k]]
    for _ in range(rounds):
        groups = {}
        for _, v in whole:
            groups.setdefault(nearest(v, around)[1], []).append(v)
        around = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(around)]
    return sorted((str(i), c, d) for i, v in whole for d, c in [nearest(v, around)]), around


def test_search_is_exact_and_measures_fewer(spark):
    rng = np.random.default_rng(2)
    for dimensions, spread, k in ((2, 4, 9), (64, 300, 16), (3, 1000, 40), (1, 3, 5)):
        around = rng.integers(-spread, spread, (k, dimensions))
        around[-1] = around[0]  # equal centroids
        vectors = np.concatenate([rng.integers(-spread, spread, (400, dimensions)), around, around + 1])
        now, best, measured = centroids.Orchard.plant(around).search(vectors)
        assert [(int(b), int(n)) for b, n in zip(best, now)] == [nearest(v, around.tolist()) for v in vectors.tolist()]
        assert measured <= len(vectors) * k
        if dimensions == 3:
            assert measured < len(vectors) * k / 2


def test_clusters_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(n, [rng.gauss(n % 4, 0.3) for _ in range(4)]) for n in range(300)]
    rows += [(n, [1.0, 2.0, 3.0, 4.0]) for n in range(300, 420)]  # repeated vectors
    rows += [(7, [0.5] * 4), (None, [0.25] * 4)]  # repeated and missing id
    bad = [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0, None, 1.0, 1.0]), (904, [1.0, math.nan, 1.0, 1.0]), (905, [1.0, math.inf, 1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<double>, Cluster int")
    for k, rounds in ((6, 3), (16, 3), (1, 2)):
        found, final = centroids.clustered(frame, "embedding", k, rounds, 1, 4, 64)
        expected, around = brute(rows + bad, k, rounds, 1, 4, 64)
        done = centroids.with_inertia(found, final).collect()
        assert sorted((str(r.vec_id), r.cluster, r.distance) for r in done) == expected
        assert final.tolist() == around
        assert {r.inertia for r in done} == {sum(d for _, _, d in expected)}
        for r in done:
            assert r.cluster_inertia == sum(d for _, c, d in expected if c == r.cluster)
            assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, around[r.cluster])).encode()).hexdigest()


def test_few_vectors_empty_table_and_huge_components(spark):
    schema = "vec_id string, embedding array<float>"
    two = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [0.0, 1.0])], schema)
    found, final = centroids.clustered(two, "embedding", 5, 2, 1, 2)
    assert final.tolist() == [[0, 64], [0, 64]]
    assert sorted(found.collect()) == [("a", 0, 0), ("b", 0, 0)]
    found, final = centroids.clustered(two.where("false"), "embedding", 5, 2, 1, 2)
    assert centroids.with_inertia(found, final).collect() == [] and final.shape == (0, 2)
    with pytest.raises(ValueError):
        centroids.clustered(spark.createDataFrame([("a", [1e30, 0.0])], schema), "embedding", 1, 1, 1, 2)
