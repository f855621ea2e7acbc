"""Pruned top-n products against all products."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tavola.operators.topk import top_products


def made(seed, rows, terms, start=0):
    """Sparse rows over terms of very different frequency; some rows are alike."""
    rng = random.Random(seed)
    out = []
    for k in range(start, start + rows):
        if k % 9 == 8:
            out += [(k, t, w) for d, t, w in out if d == k - 1]
            continue
        own = {min(int(rng.expovariate(1.0) ** 2 * terms / 8), terms - 1) for _ in range(rng.randrange(1, 9))}
        norm = len(own) ** 0.5
        out += [(k, f"t{t}", round(rng.uniform(0.2, 1.0) / norm, 6)) for t in own]
    return out


def brute(left, right, n, digits, self_too):
    a, b = defaultdict(dict), defaultdict(dict)
    for side, rows in ((a, left), (b, right)):
        for k, t, w in rows:
            side[k][t] = w
    out = {}
    for k, x in a.items():
        scored = []
        for o, y in b.items():
            s = round(sum(w * y[t] for t, w in x.items() if t in y), digits)
            if s > 0 and (self_too or o != k):
                scored.append((-s, o))
        out[k] = [(o, -s) for s, o in sorted(scored)[:n]]
    return {k: v for k, v in out.items() if v}


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, term string, w double").repartition(4)


@pytest.mark.parametrize("n,probe", [(1, 1), (3, 2), (5, 64), (4, 0)])
def test_equal_to_all_products(spark, n, probe):
    left = made(n, 120, 60)
    got = defaultdict(list)
    for r in top_products(table(spark, left), table(spark, left), n, 4, True, probe).orderBy("id", "rank").collect():
        got[r.id].append((r.other, r.score))
    want = brute(left, left, n, 4, False)
    assert got.keys() == want.keys()
    for k in want:
        assert [o for o, _ in got[k]] == [o for o, _ in want[k]] and [s for _, s in got[k]] == pytest.approx([s for _, s in want[k]])


def test_other_table_and_odd_rows(spark):
    left = [(1, "a", 1.0), (1, "b", 0.5), (2, "zzz", 1.0), (3, "a", 0.0), (4, None, 1.0), (5, "a", None)]
    right = [(10, "a", 0.5), (11, "b", 1.0), (12, "a", 0.5), (13, "c", 1.0), (14, "b", None)]
    got = [(r.id, r.other, r.score, r.rank) for r in top_products(table(spark, left), table(spark, right), 2, 3).orderBy("rank").collect()]
    assert got == [(1, 10, 0.5, 1), (1, 11, 0.5, 2)]
    assert top_products(table(spark, left), table(spark, []), 2, 3).count() == 0
    assert top_products(table(spark, []), table(spark, right), 2, 3).count() == 0


def test_frequent_terms_are_not_joined(spark):
    """A term that half of all rows hold brings no candidates where rarer ones decide."""
    rows = [(k, "common", 0.1) for k in range(400)] + [(k, f"rare{k // 8}", 0.99) for k in range(400)]
    df = table(spark, rows)
    got = top_products(df, df, 5, 4, True)
    assert got.count() == 2000 and got.where(F.floor(F.col("id") / 8) != F.floor(F.col("other") / 8)).count() == 0
