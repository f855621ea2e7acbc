"""Operator 13 against plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tavola.llm.lookup_clusters import cluster_vectors, distances

SCHEMA = "vec_id long, embedding array<float>, vector string, cluster int, hash string, n int"


def brute(rows, k, rounds, dim, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in first[:k]]
    if not centres:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centres)]
    near = [(i, *nearest(v)) for i, v in kept]
    return sorted(((i, c, d, sum(x[1] for x in near if x[2] == c), sum(x[1] for x in near),
                    hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, d, c in near), key=repr)


def told(spark, rows, **how):
    df = spark.createDataFrame([(*r, "v", 9, "h", 1) for r in rows], SCHEMA).repartition(4)
    return sorted(map(tuple, cluster_vectors(df, **how).collect()), key=repr)


def vectors(n, dim, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(dim)]) for i in range(n)]


def test_against_plain_integers(spark):
    rows = vectors(400, 6, 1)
    rows += [(1000 + k, rows[7][1]) for k in range(200)] + [rows[3]] * 5  # a third are one vector; repeated rows
    assert told(spark, rows, k=5, dim=6) == brute(rows, 5, 3, 6)
    assert told(spark, rows, k=5, dim=6, rounds=0) == brute(rows, 5, 0, 6)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(30, 3, 2) + [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [nan, 1.0, 1.0]),
                                (105, [-inf, 1.0, 1.0]), (None, [0.5, 0.25, -0.125]), (None, None), (106, [0.0, -0.0, 0.0]),
                                (107, [1e-30, -1e-30, 2e6])]
    assert told(spark, rows, k=4, dim=3) == brute(rows, 4, 3, 3)
    few = rows[:3] + rows[30:]
    assert told(spark, few, k=16, dim=3) == brute(few, 16, 3, 3)  # fewer vectors than centroids
    same = [(k, [0.5, 0.5, 0.5]) for k in range(20)]
    assert told(spark, same, k=16, dim=3) == brute(same, 16, 3, 3)  # equal centroids: all go to the first
    for none in ([], [(1, None)], [(None, [1.0, 2.0, 3.0])]):
        assert told(spark, none, k=4, dim=3) == []


def test_components_too_large_are_refused(spark):
    with pytest.raises(Exception, match="beyond"):
        told(spark, [(1, [1e9, 0.0, 0.0])], k=1, dim=3)


def test_table_gathers_equal_differences():
    rng = np.random.default_rng(0)
    for spread in (5, 10 ** 7):  # without and with gaps in the tables
        q, c = rng.integers(-spread, spread, (50, 4)), rng.integers(-spread, spread, (6, 4))
        assert (distances(q, c) == ((q[:, None] - c[None]) ** 2).sum(axis=2)).all()
    assert distances(np.zeros((0, 4), np.int64), np.zeros((2, 4), np.int64)).shape == (0, 2)
