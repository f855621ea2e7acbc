"""Operator 1 against all distances."""

import math

import duckdb
import numpy as np

from tavola.llm.ann import CentroidGraph, balanced_centroids, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, v string, query string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, 1, "v", "q", "s") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k=10):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
          if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    dim = max({len(v) for _, v in ok}, key=[len(v) for _, v in ok].count) if ok else 0
    ok = [(i, v) for i, v in ok if len(v) == dim]
    out = []
    for q in sorted({i for i, _ in ok if i % 100 == 0}):
        best = {}
        for a in [v for i, v in ok if i == q]:
            for i, v in ok:
                if i != q:
                    best[i] = min(best.get(i, math.inf), float(np.sqrt(((a - v) ** 2).sum())))
        ranked = sorted((d, i) for i, d in best.items())[:k]
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(ranked)]
    return out


def run(spark, rows, **more):
    df = frame(spark, rows)
    got = nearest_neighbours(df, df.where("vec_id % 100 = 0"), **more).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)


def test_odd_rows_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=4).round(1).tolist()) for k in range(120)]
    rows += [(1000, None), (1001, []), (1100, [0.0] * 4), (1200, [1.0, None, 0.0, 0.0]), (1300, [1.0, math.nan, 0.0, 0.0]),
             (1400, [math.inf, 0.0, 0.0, 0.0]), (1500, [1.0, 2.0]), (None, [1.0] * 4), (100, rows[100][1]), (-100, [0.5] * 4)]
    rows += [(2000 + k, [1.0, -0.0, 0.0, 0.0]) for k in range(150)] + [(3000 + k, [1.0, 0.0, 0.0, 0.0]) for k in range(101)]
    rows += [(2000, [1.0, 0.0, 0.0, 0.0])] * 60  # one row many times
    assert run(spark, rows) == brute(rows)


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0]), (2, [2.0])]) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == [] and run(spark, [(0, None)]) == []


def test_recall_and_scores(spark):
    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet'").fetchall()
    want = brute(rows)
    assert run(spark, rows, list_rows=16, shard_bytes=40 * 512, visit_ratio=9.0) == want  # every list, small shards
    got = run(spark, rows)
    assert {(q, r) for q, r, _, _ in got} == {(q, r) for q, r, _, _ in want}
    near = {(q, i) for q, _, i, _ in want}
    assert np.mean([(q, i) in near for q, _, i, _ in got]) >= 0.9
    at = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    assert all(s == float(np.sqrt(((at[q] - at[i]) ** 2).sum())) for q, _, i, s in got)


def test_balance_and_graph_walk():
    x = np.random.default_rng(2).normal(size=(3000, 8))
    c = balanced_centroids(x, 256)
    assert len(c) == 256
    g = CentroidGraph.build(c)
    found = g.search(x[:200], 1.1, 8)
    true = np.sqrt(((x[:200, None] - c[None]) ** 2).sum(axis=2))
    assert np.isinf(found).any()  # a walk, not a scan
    assert (found.argmin(axis=1) == true.argmin(axis=1)).mean() > 0.95


def recall_of(spark, x, **more):
    df = frame(spark, list(enumerate(x.tolist())))
    got = nearest_neighbours(df, df.where("vec_id % 100 = 0"), **more).collect()
    x = x.astype(np.float32).astype(float)
    asked = range(0, len(x), 100)
    want = {(q, int(i)) for q in asked for i in [i for i in np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[:11] if i != q][:10]}
    return sum((r.query_id, r.vec_id) in want for r in got) / len(want)


def test_recall_with_thousands_of_lists(spark):
    x = np.random.default_rng(4).normal(size=(20_000, 64))
    assert recall_of(spark, x / np.linalg.norm(x, axis=1, keepdims=True), list_rows=4) >= 0.95
