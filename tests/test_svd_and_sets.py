"""Truncated SVD against numpy, frequent sets against counting."""

import itertools
from collections import Counter

import numpy as np
import pytest

from tavola.operators import basket as B
from tavola.operators.svd import reconstruct, truncated_svd


def matrix(m, n, rank, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(m, rank)) @ np.diag(10.0 / 2.0 ** np.arange(rank)) @ rng.normal(size=(rank, n))
    return np.where(rng.random((m, n)) < 0.4, a, 0.0)


def table(spark, a):
    rows = [(f"u{i}", f"i{j}", float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    return spark.createDataFrame(rows, "user string, item string, value double").repartition(4)


def test_equal_to_numpy(spark):
    a = matrix(60, 25, 12)
    svd = truncated_svd(table(spark, a), rank=4, over=10, rounds=6)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert svd.values == pytest.approx(s[:4], rel=1e-4)
    items = {r.item: np.array(r.f) for r in svd.items.collect()}
    v = np.array([items[f"i{j}"] for j in range(25)])
    assert np.abs(v.T @ vt[:4].T) == pytest.approx(np.eye(4), abs=2e-2) and v.T @ v == pytest.approx(np.eye(4), abs=1e-8)
    assert all(c[np.abs(c).argmax()] > 0 for c in v.T)
    best = u[:, :4] * s[:4] @ vt[:4]
    got = reconstruct(table(spark, a), svd).collect()
    assert len(got) == np.count_nonzero(a)
    assert max(abs(r.predicted - best[int(r.user[1:]), int(r.item[1:])]) for r in got) < 0.05 * s[0] / 10


def test_low_rank_repeated_and_empty(spark):
    a = np.outer([1.0, 2.0, 3.0], [1.0, 0.0, 4.0])
    df = table(spark, a)
    svd = truncated_svd(df.unionAll(df), rank=3)
    assert svd.values == pytest.approx([2 * np.linalg.norm(a)])
    assert truncated_svd(df.limit(0)).values == [] and truncated_svd(df.limit(0)).users.count() == 0
    odd = df.unionAll(spark.createDataFrame([(None, "i0", 1.0), ("u0", None, 1.0), ("u0", "i0", None)], df.schema))
    assert truncated_svd(odd, rank=1).values == pytest.approx([np.linalg.norm(a)])


def test_frequent_sets(spark):
    rng = np.random.default_rng(1)
    baskets = {o: {f"d{k}" for k in rng.choice(9, rng.integers(1, 6), replace=False)} for o in range(200)}
    rows = [(o, i, i) for o, s in baskets.items() for i in s] + [(0, "d1", "d1"), (None, "d1", "d1"), (1, None, None)]
    df = spark.createDataFrame(rows, "order_id long, item_id string, item_name string")
    want = Counter(c for s in baskets.values() for size in (1, 2, 3) for c in itertools.combinations(sorted(s | ({"d1"} if s is baskets[0] else set())), size))
    got = {tuple(r["items"]): r.n for r in B.frequent_sets(df, min_count=12, most=3).collect()}
    assert got == {k: n for k, n in want.items() if n >= 12} and any(len(k) == 3 for k in got)
    assert B.frequent_sets(df.limit(0), 2).count() == 0


def test_frequent_sets_grow_no_deeper_than_asked(spark):
    """24 items always bought together are in 16 million sets; three items deep there are 2,324."""
    rows = [(o, f"d{k:02d}") for o in range(3) for k in range(24)] + [(9, "d00"), (9, "x"), (9, "y")]
    df = spark.createDataFrame(rows, "order_id long, item_id string")
    got = {tuple(r["items"]): r.n for r in B.frequent_sets(df, min_count=3, most=3).collect()}
    names = [f"d{k:02d}" for k in range(24)]
    assert got == {c: 4 if c == ("d00",) else 3 for size in (1, 2, 3) for c in itertools.combinations(names, size)}
    assert {tuple(r["items"]) for r in B.frequent_sets(df, 3, 1).collect()} == {(n,) for n in names}
