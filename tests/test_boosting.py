"""Leaf-wise boosting, the Parzen sampler and tree SHAP."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tavola.operators import boosting as B
from tavola.operators import explain as E
from tavola.operators.boosting import Booster, Params, Rows, Tree
from tavola.operators.tuning import SEARCH_SPACE, Parzen, Sampler

SMALL = Params(rounds=30, rate=0.2, max_depth=4, leaves=8, min_rows=5, row_share=1.0, column_share=1.0, l1=0.0, l2=0.0, stop_after=5)


def data(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    x[rng.random(n) < 0.1, 2] = np.nan
    y = np.where(x[:, 0] > 0.3, 2.0, 0.0) + np.abs(x[:, 1]) + np.where(np.isnan(x[:, 2]), 1.0, 0.0)
    return x, y


def table(spark, x, y):
    rows = [(k, *[None if math.isnan(v) else float(v) for v in r], float(t), k % 4 == 0) for k, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, held boolean").repartition(5)


def exhaustive_split(x, g, p):
    """Best (gain, feature, cut) by trying every cut of every feature."""
    best = (0.0, None, None)
    for f in range(x.shape[1]):
        for cut in range(B.BINS - 1):
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) >= p.min_rows:
                part = [max(abs(g[m].sum()) - p.l1, 0) ** 2 / (m.sum() + p.l2) for m in (low, ~low, low | ~low)]
                best = max(best, (part[0] + part[1] - part[2], -f, -cut), key=lambda r: r[0])
    return best


def test_split_is_the_best_of_all():
    rng = np.random.default_rng(0)
    bins, g = rng.integers(0, 12, (200, 3)).astype(np.uint8), rng.normal(size=200)
    for p in (Params(l1=0.0, l2=0.0, min_rows=5), Params(l1=0.5, l2=2.0, min_rows=30)):
        gain, f, cut = B.best_split(B.histogram(bins.astype(int), g, np.ones(200)), p)
        want = exhaustive_split(bins, g, p)
        assert gain == pytest.approx(want[0]) and (f, cut) == (-want[1], -want[2])


def test_growth_takes_the_best_leaf_first():
    """With few leaves the tree holds the splits of largest gain, wherever they lie."""
    x, y = data()
    edges = [np.unique(x[~np.isnan(x[:, f]), f])[::4] for f in range(3)]
    rows = Rows(B.to_bins(x, edges), y, np.ones(len(y)), np.arange(len(y)), np.zeros(len(y), bool))
    for leaves in (2, 3, 5, 8):
        t = B.fit_rows(rows, list("abc"), edges, "squared", Params(rounds=1, leaves=leaves, row_share=1.0, column_share=1.0, max_depth=9)).trees[0]
        assert (t.feature < 0).sum() == leaves and t.rows[0] == len(y)
        leaf = t.leaf_of(rows.bins)
        for k in np.unique(leaf):
            assert t.feature[k] < 0 and t.rows[k] == (leaf == k).sum() >= 20
    deep = B.fit_rows(rows, list("abc"), edges, "squared", Params(rounds=1, leaves=64, max_depth=2, row_share=1.0)).trees[0]
    assert deep.depth == 2 and (deep.feature < 0).sum() <= 4


@pytest.mark.parametrize("share", [1.0, 0.7])
def test_spread_fit_equals_the_fit_in_one_task(spark, share):
    x, y = data()
    df = table(spark, x, y)
    p = Params(rounds=6, rate=0.2, max_depth=4, leaves=6, min_rows=5, row_share=share, column_share=share, stop_after=3)
    one = B.fit(df, ["a", "b", "c"], "y", p, valid=F.col("held"))
    spread = B.fit(df, ["a", "b", "c"], "y", p, valid=F.col("held"), task_rows=10)
    assert len(one.trees) == len(spread.trees) and one.base == pytest.approx(spread.base)
    for s, t in zip(one.trees, spread.trees):
        assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and s.value == pytest.approx(t.value)
    assert one.curve == pytest.approx(spread.curve)


def test_quality_stopping_and_save(spark, tmp_path):
    from tavola.sources.io import load_model, save_model
    x, y = data(2000)
    df = table(spark, x, y)
    model = B.fit(df, ["a", "b", "c"], "y", Params(rounds=400, rate=0.1, stop_after=10), valid=F.col("held"))
    assert len(model.trees) == int(np.argmin(model.curve)) + 1 and len(model.curve) <= len(model.trees) + 10
    assert np.mean((model.predict(x) - y) ** 2) < 0.02 * y.var()
    save_model(model, str(tmp_path / "m"), {"target": "y"})
    back, meta = load_model(str(tmp_path / "m"))
    assert meta == {"target": "y"} and (back.predict(x) == model.predict(x)).all()
    scored = df.withColumn("p", back.column()).orderBy("id").toPandas()
    assert scored["p"].to_numpy() == pytest.approx(model.predict(x))


def test_logistic_and_odd_tables(spark):
    x, y = data()
    df = table(spark, x, (y > 1.2).astype(float)).withColumn("w", F.lit(2.0))
    model = B.fit(df, ["a", "b", "c"], "y", SMALL, "logistic", "w")
    p = model.predict(x)
    assert ((p > 0.5) == (y > 1.2)).mean() > 0.95 and p.min() > 0 and p.max() < 1
    assert B.fit(df.limit(0), ["a"], "y", SMALL).trees == []
    assert B.fit(df.withColumn("y", F.lit(3.0)), ["a", "b"], "y", SMALL).predict(x[:, :2]) == pytest.approx(np.full(len(x), 3.0))
    nothing = B.fit(df.withColumn("a", F.lit(None).cast("double")), ["a"], "y", SMALL, "logistic")
    assert len(set(nothing.predict(np.full((3, 1), np.nan)).tolist())) == 1


def test_folds_side_by_side(spark):
    x, y = data(900)
    df = table(spark, x, y).withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1))))
    cut = B.binned_folds(df, ["a", "b", "c"], "y", (F.col("id") % 2) == F.col("fold"))
    models = B.fit_folds(cut, [(0, SMALL), (1, Params(rounds=1, row_share=1.0, column_share=1.0))])
    assert [(t, f) for t, f, _ in models] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    for r in B.scores(cut, models).collect():
        model = next(m for t, f, m in models if (t, f) == (r.trial, r.fold))
        here = np.arange(900) % 2 == r.fold
        gap = model.predict(x[here]) - y[here]
        assert r.n == 450 and r.mae == pytest.approx(np.abs(gap).mean()) and r.rmse == pytest.approx(np.sqrt((gap ** 2).mean()))
        assert r.r2 == pytest.approx(1 - (gap ** 2).sum() / ((y[here] - y[here].mean()) ** 2).sum())
    small = B.binned_folds(df, ["a", "b", "c"], "y", (F.col("id") % 2) == F.col("fold"), fold_rows=100)
    sampled = B.fit_folds(small, [(0, SMALL)])
    assert all(m.trees[0].rows[0] < 200 for _, _, m in sampled) and {r.n for r in B.scores(small, sampled).collect()} == {450}


def test_large_folds_are_fitted_on_all_their_rows(spark):
    rows = spark.range(600_000).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 % 2).cast("double").alias("y"),
                                       (F.col("id") % 2).cast("int").alias("fold"), F.lit(False).alias("held"))
    p = Params(rounds=1, row_share=1.0, column_share=1.0)
    for _, _, m in B.fit_folds(B.binned_folds(rows, ["a"], "y", F.col("held")), [(0, p)]):
        assert m.trees[0].rows[0] == 300_000
    x, y = data(900)
    df = table(spark, x, y).withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1))))
    inside = B.binned_folds(df, ["a", "b", "c"], "y", (F.col("id") % 2) == F.col("fold"))
    spread = B.binned_folds(df, ["a", "b", "c"], "y", (F.col("id") % 2) == F.col("fold"), task_rows=100)
    for (_, k, one), (_, j, other) in zip(B.fit_folds(inside, [(0, SMALL)]), B.fit_folds(spread, [(0, SMALL)])):
        assert k == j and len(one.trees) == len(other.trees) and one.trees[0].rows[0] == 450
        for s, t in zip(one.trees, other.trees):
            assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and s.value == pytest.approx(t.value)


def test_values_are_those_of_the_leaves():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(3000, 4)), rng.normal(size=3000)
    edges = [np.quantile(x[:, f], np.linspace(0.01, 0.99, 90)) for f in range(4)]
    rows = Rows(B.to_bins(x, edges), y, np.ones(3000), np.arange(3000), np.zeros(3000, bool))
    for leaves in (1, 2, 31, 64, 65, 127):
        t = B.fit_rows(rows, list("abcd"), edges, "squared", Params(rounds=1, leaves=leaves, max_depth=30, min_rows=2, l1=0.0)).trees[0]
        assert (t.feature < 0).sum() == leaves
        assert (t.values(np.ascontiguousarray(rows.bins.T)) == t.value[t.leaf_of(rows.bins)]).all()


# --------------------------------------------------------------------------- search
def test_parzen_density_is_one():
    p = Parzen([0.1, 0.2, 0.9], 0.0, 1.0)
    grid = np.linspace(0, 1, 20001)
    assert np.exp(p.log_density(grid)).mean() == pytest.approx(1.0, abs=1e-3)
    draws = p.draw(np.random.default_rng(0), 2000)
    assert draws.min() >= 0 and draws.max() <= 1
    assert (draws < 0.3).mean() == pytest.approx(np.exp(p.log_density(grid[grid < 0.3])).sum() / 20001, abs=0.05)


def test_sampler_beats_chance_and_stays_inside():
    def score(q):
        return (math.log(q["rate"]) - math.log(0.05)) ** 2 + ((q["leaves"] - 40) / 20) ** 2 + abs(q["row_share"] - 0.9)
    guided, chance = [], []
    for seed in range(8):
        for out, startup in ((guided, 10), (chance, 60)):
            s = Sampler(SEARCH_SPACE, seed, startup)
            for _ in range(60):
                q = s.propose()
                assert all(low <= q[k] <= high and (kind != "int" or isinstance(q[k], int)) for k, (kind, low, high) in SEARCH_SPACE.items())
                s.tell(q, score(q))
            out.append(min(s.scores))
    assert np.mean(guided) < 0.7 * np.mean(chance)
    again = [Sampler(SEARCH_SPACE, 5).propose() for _ in range(2)]
    assert again[0] == again[1]


def test_best_trial_gives_the_parameters(spark):
    from tavola.operators import ml
    trials = spark.createDataFrame([(0, '{"leaves": 20, "rate": 0.1}', 5.0), (1, '{"leaves": 33, "rate": 0.02}', 4.0),
                                    (2, '{"leaves": 40, "rate": 0.03}', 4.0)], "trial int, params string, cv_rmse double")
    p = ml.best_params(trials)
    assert (p.leaves, p.rate, p.rounds) == (33, 0.02, 500)


# --------------------------------------------------------------------------- SHAP
def worth(tree: Tree, bins, known, at=0):
    """Expected value of the tree for one row when only the features in ``known`` are seen."""
    f = tree.feature[at]
    if f < 0:
        return tree.value[at]
    left, right = tree.left[at], tree.right[at]
    if f in known:
        return worth(tree, bins, known, left if bins[f] <= tree.cut[at] else right)
    return sum(tree.rows[c] / tree.rows[at] * worth(tree, bins, known, c) for c in (left, right))


def test_tree_values_equal_the_sum_over_all_subsets():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = x[:, 0] * x[:, 1] + np.sin(x[:, 2]) + 0.1 * x[:, 3]
    edges = [np.quantile(x[:, f], np.linspace(0.05, 0.95, 19)) for f in range(4)]
    rows = Rows(B.to_bins(x, edges), y, np.ones(300), np.arange(300), np.zeros(300, bool))
    model = B.fit_rows(rows, list("abcd"), edges, "squared", Params(rounds=3, rate=0.5, max_depth=6, leaves=14, min_rows=5, row_share=1.0, column_share=1.0))
    got = E.row_values(model, x[:20])
    for r in range(20):
        for f in range(4):
            others, want = [k for k in range(4) if k != f], 0.0
            for size in range(4):
                for s in itertools.combinations(others, size):
                    share = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                    want += share * sum(worth(t, rows.bins[r], {*s, f}) - worth(t, rows.bins[r], set(s)) for t in model.trees)
            assert got[r, f] == pytest.approx(want, abs=1e-9)
    assert got.sum(axis=1) + E.mean_value(model) == pytest.approx(model.raw(rows.bins[:20]))


def test_agreements_are_worked_out_once_for_many_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (500, 20)).astype(float)
    edges = [np.array([0.5])] * 20
    for deep in (7, 12, 18):  # the path to the deepest leaf has so many features, one code of a byte or two or four a row
        k = np.arange(deep)
        feature = np.concatenate([k, np.full(deep + 1, -1)])
        left, right = np.where(feature >= 0, deep + np.arange(2 * deep + 1), -1), np.where(feature >= 0, np.arange(2 * deep + 1) + 1, -1)
        right[deep - 1], left[:deep] = 2 * deep, deep + k
        rows = np.concatenate([2.0 ** (deep - k), 2.0 ** (deep - 1 - k), [1.0]])
        value = np.concatenate([np.zeros(deep), rng.normal(size=deep + 1)])
        tree = Tree(feature, np.where(feature >= 0, 1, -1), left, right, value, rows, np.zeros(2 * deep + 1), deep)
        model = Booster([f"f{j}" for j in range(20)], edges, "squared", 0.0, [tree])
        got = E.row_values(model, x)
        assert got.sum(axis=1) + E.mean_value(model) == pytest.approx(model.raw(model.bins(x)))
        assert (got[:, deep:] == 0).all()
    batches, worked = [], []
    monkeypatch.setattr(E, "row_values", lambda m, part: worked.append(len(part)) or np.zeros(part.shape))
    df = spark.createDataFrame([(0, *[0.0] * 20)], ["id", *model.features])
    monkeypatch.setattr(type(df), "mapInArrow", lambda df, run, schema: batches.append(run) or df)
    E.shap_values(model, df, ["id"])
    part = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([[0.0] * 20] * 100)], ["id", "_x"])
    assert sum(b.num_rows for b in batches[0](iter([part] * 7))) == 700 and worked == [700]


def test_shap_over_a_table(spark):
    x, y = data(400)
    df = table(spark, x, y)
    model = B.fit(df, ["a", "b", "c"], "y", SMALL)
    values = E.shap_values(model, df, ["id"])
    got = values.orderBy("id").toPandas()
    assert got[["shap_a", "shap_b", "shap_c"]].to_numpy() == pytest.approx(E.row_values(model, x))
    assert (got["expected"] + got[["shap_a", "shap_b", "shap_c"]].sum(axis=1)).to_numpy() == pytest.approx(got["raw"].to_numpy())
    top = E.shap_importance(values, ["a", "b", "c"]).collect()
    assert [r.mean_shap_value for r in top] == sorted((r.mean_shap_value for r in top), reverse=True)
    assert top[0].mean_shap_value == pytest.approx(np.abs(E.row_values(model, x)).mean(axis=0).max())
    assert E.shap_values(model, df.limit(0), ["id"]).count() == 0
    assert isinstance(model, Booster)
