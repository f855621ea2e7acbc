"""Per-row explanations of boosted trees: path-dependent tree SHAP.

A leaf's share of a prediction depends on the row only through which of the
path's features the row agrees with; a feature the row does not follow leaves
the path with the share of training rows that took it.  For every leaf the
agreements that occur in a batch are told apart, their Shapley values computed
once each, and gathered for the rows: one pass over the rows, for all trees.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Booster, Tree, feature_array

AT_ONCE = 1 << 16  # rows explained together, about: the agreements that occur are worked out once for all of them


def paths(tree: Tree) -> list[tuple[float, list[tuple[int, float, list[tuple[int, bool]]]]]]:
    """For each leaf: its value and, for each feature on the way, the share of rows that goes on
    and the (node, goes left) turns taken."""
    out, waiting = [], [(0, {})]
    while waiting:
        at, met = waiting.pop()
        f = int(tree.feature[at])
        if f < 0:
            out.append((float(tree.value[at]), [(k, share, turns) for k, (share, turns) in met.items()]))
            continue
        for child, left in ((int(tree.left[at]), True), (int(tree.right[at]), False)):
            share, turns = met.get(f, (1.0, []))
            waiting.append((child, {**met, f: (share * tree.rows[child] / tree.rows[at], [*turns, (at, left)])}))
    return out


def expected(tree: Tree) -> float:
    """The mean value of the training rows' leaves."""
    leaf = tree.feature < 0
    return float((tree.value[leaf] * tree.rows[leaf]).sum() / tree.rows[0])


def shapley(agrees: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley value of each of the path's features, for a leaf worth 1.

    ``agrees`` is patterns x features.  A set S of known features is worth the
    product of 1 or 0 over S (does the row agree) and of the shares over the
    rest.  ``weight`` sums that product over all sets of a size, without one feature.
    """
    n, d = agrees.shape
    weight = np.zeros((n, d, d))  # pattern, the feature left out, size of the set
    weight[:, :, 0] = 1.0
    for j in range(d):
        others = np.arange(d) != j
        w = weight[:, others]
        more = w * shares[j]
        more[:, :, 1:] += w[:, :, :-1] * agrees[:, j, None, None]
        weight[:, others] = more
    # a set of k of the d - 1 others comes before a feature in a share 1 / (d * C(d - 1, k)) of the orders
    before = np.array([1.0 / (d * math.comb(d - 1, k)) for k in range(d)])
    return (weight @ before) * (agrees - shares)


def agreement(cols: np.ndarray, tree: Tree, met: list[tuple[int, float, list[tuple[int, bool]]]]) -> np.ndarray:
    """For each row of features x rows bins a number whose bits tell which of the path's features it agrees with.
    The turns on a feature leave an interval of its bins."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(met) <= 8 * k().itemsize)
    code = np.zeros(cols.shape[1], kind)
    for j, (f, _, turns) in enumerate(met):
        first = max((int(tree.cut[node]) + 1 for node, left in turns if not left), default=0)
        last = min((int(tree.cut[node]) for node, left in turns if left), default=255)
        code |= (cols[f] - np.uint8(first) <= np.uint8(last - first)).astype(kind) << kind(j)
    return code


def tree_values(tree: Tree, cols: np.ndarray, out: np.ndarray) -> None:
    """Adds the tree's Shapley values of features x rows bins to ``out`` (features x rows)."""
    for value, met in paths(tree):
        if not met:
            continue
        code = agreement(cols, tree, met)
        if len(met) <= 16:
            at = code.astype(np.intp)
            seen = np.flatnonzero(np.bincount(at, minlength=1 << len(met)))
            back = at
        else:
            seen, back = np.unique(code, return_inverse=True)
        bits = np.arange(len(met)).astype(seen.dtype)
        told = shapley((seen[:, None] >> bits & seen.dtype.type(1)).astype(float), np.array([share for _, share, _ in met])) * value
        table = told.T
        if len(met) <= 16:
            table = np.zeros((len(met), 1 << len(met)))
            table[:, seen] = told.T
        for j, (f, _, _) in enumerate(met):
            out[f] += np.ascontiguousarray(table[j])[back]


def row_values(model: Booster, x: np.ndarray) -> np.ndarray:
    """Shapley values of each row (of the raw value: log odds for a probability)."""
    cols = np.ascontiguousarray(model.bins(x).T)
    out = np.zeros(cols.shape)
    for tree in model.trees:
        tree_values(tree, cols, out)
    return out.T


def mean_value(model: Booster) -> float:
    """What the row values are relative to."""
    return model.base + sum(expected(t) for t in model.trees)


def shap_values(model: Booster, df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``expected``, ``raw`` and a ``shap_<feature>`` column for every row; the values and
    ``expected`` add up to ``raw``.  One pass; a null feature is a missing value as in training."""
    handle = df.sparkSession.sparkContext.broadcast(model)  # rounds x leaves nodes
    names = [f"shap_{c}" for c in model.features]
    start, width = mean_value(model), len(model.features)

    def told(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        for at in range(0, rows.num_rows, AT_ONCE):
            part = rows.slice(at, AT_ONCE)
            x = part.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            values = row_values(handle.value, x)
            raw = handle.value.raw(handle.value.bins(x))
            out = pa.table([*(part.column(k) for k in keys), pa.array(np.full(len(x), start)), pa.array(raw),
                            *(pa.array(values[:, j].copy()) for j in range(width))], [*keys, "expected", "raw", *names])
            yield from out.combine_chunks().to_batches()

    def run(batches):
        held = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= AT_ONCE:
                yield from told(held)
                held = []
        if held:
            yield from told(held)
    kept = df.select(*keys, feature_array(model.features).alias("_x"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keys]
    return kept.mapInArrow(run, ", ".join([*kinds, "expected double", "raw double", *[f"`{n}` double" for n in names]]))


def shap_importance(values: DataFrame, features: list[str], n: int | None = None) -> DataFrame:
    """mean absolute value of each feature over all rows, largest first."""
    means = values.agg(*[F.avg(F.abs(f"shap_{c}")).alias(c) for c in features])
    long = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_shap_value"))
                                            for c in features])).alias("_r")).select("_r.*")
    out = long.orderBy(F.desc("mean_shap_value"), "feature")
    return out.limit(n) if n else out
