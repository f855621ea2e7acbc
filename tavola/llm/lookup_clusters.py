"""Centroid clustering of integer vectors by scalar lookup tables (operator 13).

Components become the integers floor(scale * x).  In each round a task tabulates,
for one dimension at a time, the squared difference of every integer that occurs
in its batch to that dimension of every centroid; a vector's distances are the
sum of the table rows its components point at, so no difference is taken twice.
Tasks return at most one row a centroid (a count and integer sums), which Spark
adds up; the driver sees those few rows only.  Everything is whole-number
arithmetic, so the result does not depend on how the table is partitioned, and a
lost task is simply run again from the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 8192  # vectors at a time
DENSE = 1 << 16  # widest run of integers that a table covers without gaps
LARGEST = 1 << 27  # of a component: sums of squared differences stay exact in 64 bits
RESULT = "vec_id long, cluster int, distance long"


def usable(vectors: DataFrame, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of the rows with ``dim`` components, none of them null, NaN or infinite."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where((F.size(vector_col) == dim) & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))


def seeds(kept: DataFrame, k: int, scale: float) -> np.ndarray:
    """The vectors with the ``k`` smallest SHA-256 of ``1:<vec_id>``, as integers; equal ids by their components."""
    hashed = kept.where("vec_id IS NOT NULL").select(
        F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("hash"), "vector")
    rows = hashed.orderBy("hash", "vector").limit(k).collect()  # k rows
    return np.array([_integers(np.array(r.vector)[None], scale)[0] for r in rows], np.int64)


def _integers(vectors: np.ndarray, scale: float) -> np.ndarray:
    q = np.floor(scale * vectors)
    if len(q) and np.abs(q).max() > LARGEST:
        raise OverflowError(f"a component times {scale} is beyond {LARGEST}: exact 64-bit distances need smaller ones")
    return q.astype(np.int64)


def distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of every integer vector to every centroid, gathered from one table a dimension."""
    out = np.zeros((len(q), len(centroids)), np.int64)
    for d in range(q.shape[1] if len(q) else 0):
        column = q[:, d]
        low, high = column.min(), column.max()
        if high - low < DENSE:
            occurring, codes = np.arange(low, high + 1), column - low
        else:
            occurring, codes = np.unique(column, return_inverse=True)
        table = (occurring[:, None] - centroids[None, :, d]) ** 2
        out += table[codes]
    return out


def _batches(batches, dim: int, scale: float) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer vectors, a bounded number at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column("vec_id"), _integers(part.column("vector").flatten().to_numpy().reshape(-1, dim), scale)


def _nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = distances(q, centroids)
    cluster = far.argmin(axis=1)  # the first of equals: the smaller number
    return cluster, far[np.arange(len(far)), cluster]


def _totals(kept: DataFrame, centroids: np.ndarray, scale: float) -> list:
    """A row for each centroid that has vectors: ``cluster``, ``n``, ``inertia`` and the component sums ``s0``, ``s1``..."""
    k, dim = centroids.shape
    names = ["cluster", "n", "inertia", *[f"s{d}" for d in range(dim)]]

    def run(batches):
        total = np.zeros((k, dim + 2), np.int64)
        for _, q in _batches(batches, dim, scale):
            cluster, near = _nearest(q, centroids)
            total[:, 0] += np.bincount(cluster, minlength=k)
            np.add.at(total[:, 1], cluster, near)
            for c in np.unique(cluster):
                total[c, 2:] += q[cluster == c].sum(axis=0)
        met = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), *[pa.array(x) for x in total[met].T]], names)

    parts = kept.mapInArrow(run, ", ".join(f"{x} long" for x in names))
    return parts.groupBy("cluster").agg(*[F.sum(x).alias(x) for x in names[1:]]).collect()  # k rows


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Cluster, squared distance, inertia and final centroid of every usable vector.

    Result: ``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``,
    ``inertia``, ``centroid_sha256``.  Vectors that are null, of another length,
    or hold a null or non-finite component take no part.  Each repeated row
    counts and is returned; a null id is clustered but cannot be a first
    centroid; equal distances go to the smaller number; a centroid without
    vectors stays where it is.  With fewer than ``k`` usable ids there are as
    many centroids as ids; an empty table (or one without ids) gives no rows.
    Other columns are ignored.  Integers beyond 2^27 are refused with an
    ``OverflowError``, since their distances do not fit 64 bits.
    """
    spark = vectors.sparkSession
    kept = usable(vectors, dim, id_col, vector_col)
    centroids = seeds(kept, k, scale)
    if not len(centroids):
        return spark.createDataFrame([], RESULT + ", cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = centroids.copy()
        for row in _totals(kept, centroids, scale):
            centroids[row["cluster"]] = [row[f"s{d}"] // row["n"] for d in range(dim)]
    inertia = {row["cluster"]: row["inertia"] for row in _totals(kept, centroids, scale)}

    def run(batches):
        for ids, q in _batches(batches, dim, scale):
            cluster, near = _nearest(q, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(near)],
                                             ["vec_id", "cluster", "distance"])

    told = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
            for c, row in enumerate(centroids.tolist())]
    of = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return kept.mapInArrow(run, RESULT).join(F.broadcast(of), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
