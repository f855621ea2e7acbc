"""Rank-quantile and value-quantile bins against their pandas definitions."""

import numpy as np
import pandas as pd

from tavola.functions.bins import global_rank, quantile_bins, rank_bins


def test_rank_bins_match_pandas_qcut(spark):
    rng = np.random.default_rng(7)
    for n in (7, 8, 50, 333):
        vals = rng.integers(0, 5, n).astype(float)  # heavy ties
        pdf = pd.DataFrame({"key": np.arange(n), "x": vals})
        expected = pd.qcut(pdf["x"].rank(method="first"), 5, labels=range(1, 6)).astype(int).tolist()
        df = spark.createDataFrame(pdf)
        got = rank_bins(df, "x", 5, "key", "b").orderBy("key").select("b").toPandas()["b"].tolist()
        assert got == expected, n


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 101 AS v")
    r = global_rank(df, ["v", "id"], "r").toPandas().sort_values("r")
    assert r["r"].tolist() == list(range(1, 1001))
    assert (r[["v", "id"]].values.tolist() == sorted(r[["v", "id"]].values.tolist()))


def test_quantile_bins_match_pandas(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(100, 20, 400).round(2)
    pdf = pd.DataFrame({"k": np.arange(400), "x": x})
    expected = pd.qcut(pdf["x"], 5, labels=range(1, 6)).astype(int).tolist()
    got = quantile_bins(spark.createDataFrame(pdf), "x", 5, "b").orderBy("k").toPandas()["b"].tolist()
    assert got == expected
