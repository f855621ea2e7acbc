"""Hybrid recommendations against a plain rule, and the shuffles that they take."""

import random
from collections import defaultdict

import pytest

from tavola.llm.common import written
from tavola.operators import basket
from tavola.operators.basket import recommend_hybrid


def brute(baskets, edges, similar, n, excluded):
    have, gone = defaultdict(set), defaultdict(set)
    for b, i in baskets:
        have[b].add(i)
    for b, i in baskets + excluded:
        gone[b].add(i)
    out = {}
    for b, items in have.items():
        lift, content = defaultdict(float), {}
        for s, d, w in edges:
            if s in items and d not in gone[b]:
                lift[d] += w
        cooc = dict(sorted(((d, round(w, 4)) for d, w in lift.items()), key=lambda x: (-x[1], x[0]))[:2 * n])
        for i in items:
            near = sorted((-w, o) for s, o, w in similar if s == i and o not in gone[b])[:n]
            for w, o in near:
                content[o] = max(content.get(o, 0.0), -w)
        mc, mt = max(cooc.values(), default=0), max(content.values(), default=0)
        scored = [(round(0.6 * (cooc.get(i, 0.0) / mc if mc else 0) + 0.4 * (content.get(i, 0.0) / mt if mt else 0), 4), i)
                  for i in {*cooc, *content}]
        for r, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:n], 1):
            out[b, r] = (i, s)
    return out


@pytest.mark.parametrize("excluding", [False, True])
def test_equal_to_plain_rule_with_one_shuffle_of_baskets(spark, monkeypatch, excluding):
    monkeypatch.setattr(basket, "DEALT_ROWS", 64)
    rng = random.Random(4)
    items = [f"i{k:02d}" for k in range(30)]
    baskets = [(b, i) for b in range(60) for i in rng.sample(items, rng.randrange(1, 28 if b == 3 else 6))] + [(99, "unknown")]
    excluded = [(b, i) for b in range(0, 80, 2) for i in rng.sample(items, 8)] if excluding else []
    edges = [(s, d, rng.randrange(1, 64) / 16) for s in items for d in rng.sample(items, 4) if s != d]
    similar = [(s, o, rng.randrange(1, 64) / 64) for s in items[2:] for o in rng.sample(items, 20) if s != o]
    table = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = recommend_hybrid(table(baskets, "basket long, item string"), written(table(edges, "src string, dst string, lift double")),
                           written(table(similar, "item string, other string, score double")), 3,
                           exclude=table(excluded, "basket long, item string") if excluding else None)
    want = brute(baskets, edges, similar, 3, excluded)
    rows = {(r.basket, r["rank"]): (r.item, r.score) for r in got.collect()}
    assert {k: v[0] for k, v in rows.items()} == {k: v[0] for k, v in want.items()}
    assert [rows[k][1] for k in sorted(rows)] == pytest.approx([want[k][1] for k in sorted(want)], abs=1e-4)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(basket") == 1
