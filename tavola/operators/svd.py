"""Truncated SVD of the sparse user-item matrix by block power iteration.

The matrix stays in long form (user, item, value).  A block of ``rank + over``
vectors, a row a user or item, is multiplied by it and by its transpose in turn:
an equi join and a grouped sum, with partial sums before the shuffle.  After each
product the block is made orthonormal: its Gram matrix is one aggregate, the
small eigenproblem is solved on the driver, and the rows are turned by the
result.  Only block x block numbers leave the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


@dataclass
class Svd:
    """Singular values, and the factors as (user, f) and (item, f) with an array a row."""

    values: list[float]
    users: DataFrame
    items: DataFrame


def _names(n: int) -> list[str]:
    return [f"c{j}" for j in range(n)]


def _product(matrix: DataFrame, block: DataFrame, by: str, over: str, n: int) -> DataFrame:
    return matrix.join(block, over).groupBy(by).agg(*[F.sum(F.col("value") * F.col(c)).alias(c) for c in _names(n)])


def _gram(block: DataFrame, n: int) -> np.ndarray:
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    row = block.agg(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")) for i, j in pairs]).first()
    out = np.zeros((n, n))
    for (i, j), v in zip(pairs, row):
        out[i, j] = out[j, i] = v or 0.0
    return out


def _turned(block: DataFrame, key: str, m: np.ndarray) -> DataFrame:
    """The block times a small matrix."""
    def column(j: int) -> Column:
        out = F.lit(0.0)
        for i in range(m.shape[0]):
            out = out + F.col(f"c{i}") * F.lit(float(m[i, j]))
        return out
    return block.select(key, *[column(j).alias(f"c{j}") for j in range(m.shape[1])])


def _orthonormal(block: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """The block with orthonormal columns, and their number: directions of no length are dropped."""
    value, vector = np.linalg.eigh(_gram(block, n))
    keep = value > max(value.max(), 0.0) * 1e-12
    return _turned(block, key, vector[:, keep] / np.sqrt(value[keep])), int(keep.sum())


def truncated_svd(matrix: DataFrame, rank: int = 5, over: int = 8, rounds: int = 4, seed: int = 42) -> Svd:
    """The ``rank`` largest singular values and their factors (fewer if the matrix has a lower rank).

    ``matrix`` has user, item, value; a null in any of them is no entry, entries
    of one cell are summed.  ``users`` are U S and ``items`` V, so a value is the
    dot product of the two rows; the largest component of each column of V is
    positive.  An empty matrix has no values."""
    ensure_checkpoint_dir(matrix.sparkSession)
    a = (matrix.where("user IS NOT NULL AND item IS NOT NULL AND value IS NOT NULL").groupBy("user", "item")
         .agg(F.sum(F.col("value").cast("double")).alias("value")).checkpoint())
    n = rank + over
    # a start of random signs that depends on the item alone, whatever the partitioning
    block = a.select("item").distinct().select("item", *[
        F.when(F.pmod(F.xxhash64("item", F.lit(seed), F.lit(j)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias(f"c{j}") for j in range(n)])
    block = _product(a, block, "user", "item", n).checkpoint()
    for _ in range(rounds):
        block, n = _orthonormal(block, "user", n)
        if not n:
            break
        block = _product(a, block, "item", "user", n).checkpoint()
        block, n = _orthonormal(block, "item", n)
        block = _product(a, block, "user", "item", n).checkpoint()
    users, n = _orthonormal(block, "user", n) if n else (block, 0)
    if not n:
        none = F.array().cast("array<double>").alias("f")
        return Svd([], a.select("user", none).limit(0), a.select("item", none).limit(0))
    users = users.checkpoint()
    items = _product(a, users, "item", "user", n).checkpoint()
    square, vector = np.linalg.eigh(_gram(items, n))
    order = np.argsort(-square)[:rank]
    order = order[square[order] > max(square.max(), 0.0) * 1e-12]
    s = np.sqrt(square[order])
    items = _turned(items, "item", vector[:, order] / s)
    k = len(s)
    top = items.agg(*[F.max_by(f"c{j}", F.struct(F.round(F.abs(f"c{j}"), 9), "item")).alias(f"c{j}") for j in range(k)]).first()
    sign = np.array([-1.0 if top[f"c{j}"] < 0 else 1.0 for j in range(k)])
    factors = lambda df, key, m: _turned(df, key, m).select(key, F.array(*_names(k)).alias("f"))
    return Svd(s.tolist(), factors(users, "user", vector[:, order] * s * sign), factors(items, "item", np.diag(sign)))


def reconstruct(pairs: DataFrame, svd: Svd) -> DataFrame:
    """The value that the factors give each (user, item) of ``pairs``."""
    dot = F.aggregate(F.zip_with("uf", "vf", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    return (pairs.join(svd.users.withColumnRenamed("f", "uf"), "user").join(svd.items.withColumnRenamed("f", "vf"), "item")
            .withColumn("predicted", dot).drop("uf", "vf"))
